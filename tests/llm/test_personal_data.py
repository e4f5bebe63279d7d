"""Added kinds of personal data that are longer than any window, and the usual forms of street words."""

import time

import pytest

from corpusmill.llm import pii


def found(text, kind):
    return [text[a:z] for k, a, z in pii.spans(text) if pii.KINDS[k] == kind]


@pytest.mark.parametrize("n", [10, 79, 310, 319, 5000])
def test_long_urls_and_spelled_emails_are_found_whole(n):
    url = f"https://user:{'eyJ.' * n}@db.example.org"
    assert found(f"see {url}/path", "url_user") == [url]
    crossing = f"ftp://{'u' * n}@{'h' * 30}.example.org"
    assert found(f"see {crossing} now", "url_user") == [crossing]
    scheme = f"{'s' * n}://a:b@h.example.org"
    assert found(f"({scheme})", "url_user") == [scheme]
    email = f"{'u.' * n}x [at] {'sub [dot] ' * n}example [dot] org"
    assert found(f"({email})", "email_text") == [email]


@pytest.mark.parametrize("cue", ["St", "Ave", "Rd", "Way", "Place", "street", "STREET", "Street", "rd", "AVE"])
def test_street_words(cue):
    assert found(f"at 12b Old Mill {cue}, near", "address") == [f"12b Old Mill {cue}"]
    assert found(f"at 12b Old Mill {cue}x, near", "address") == []


def test_a_long_address_is_whole():
    names = " ".join(["A" + "b" * 19] * 4)
    assert found(f"at 123456c {names} Road.", "address") == [f"123456c {names} Road"]


@pytest.mark.parametrize("text", ["12 main street", "1234567 Long Road", "7 one two three four five six seven lane", "9B Rue d'Or St.", "5 Street Road", "3 " + "Abcdefghij" * 9 + " Square"])
def test_addresses_of_any_length_and_case(text):
    whole = text.rstrip(".")
    assert found(f"at {text}, near", "address") == [whole]


@pytest.mark.parametrize("text", ["in 2019 we walked down the street", "12 Main street the", "012 Main Street", "a12 Main Street", "12 main Street", "12, Main Street", "12 Street"])
def test_what_is_no_address(text):
    assert found(text, "address") in ([], ["12 Main street"] if text.startswith("12 Main street") else [])


def test_many_street_words_take_time_in_proportion():
    for text in ("Main Street " * 30_000, "main street " * 30_000, "4 Street " * 30_000):
        start = time.perf_counter()
        pii.spans(text)
        assert time.perf_counter() - start < 5
