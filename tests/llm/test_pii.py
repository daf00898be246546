"""Spans against plain regular expressions over the whole text."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from pixelspark.llm import pii

AUTO = pii._automaton()


def plain(text):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a0123456789.+-@ ()%é:/\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    got = pii.find_spans(text, AUTO)
    assert {k: got[k] for k in pii.BASE_KINDS} == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4417744280351547", "4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "a.b@c.d.e", "@x.y", "+1 (017) 555-7713", "+", ".", " ", "-", "é", "7"]), max_size=12))
def test_pieces_in_a_row(parts):
    text = "".join(parts)
    got = pii.find_spans(text, AUTO)
    assert {k: got[k] for k in pii.BASE_KINDS} == plain(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(max_size=40), st.lists(st.sampled_from(["iban ", "IBAN: DE89 3704 0044 0532 0130 00", "iban TR33 0006 1005 1978 6457 8413 ", "ssn ", "123-45-6789", "token=", "ab12cd", "\u0130stanbul", "\u212a", "\u017f", "e\u0301", "\u0661\u0662\u0663", "\uff11", "@", "a.b", "://", "\u00df"]), max_size=10))
def test_all_of_unicode(text, parts):
    for t in (text, "".join(parts), text.join(parts)):
        got = pii.find_spans(t, AUTO)
        assert {k: got[k] for k in pii.BASE_KINDS} == plain(t)


def test_identifiers_are_ascii():
    text = "iban TR33 0006 1005 1978 6457 8413 26 \u0130stanbul, iban D\u212a89370400440532013000, token a\u017fb12cd34"
    assert [text[a:b] for a, b in pii.find_spans(text, AUTO)["account"]] == ["TR33 0006 1005 1978 6457 8413 26"]


def test_added_kinds():
    text = 'see https://a.example/x?y=1. then token = "f4fddc3c96e5" IBAN: DE89370400440532013000, account of none'
    got = pii.find_spans(text, AUTO)
    assert [text[a:b] for a, b in got["url"]] == ["https://a.example/x?y=1"]
    assert [text[a:b] for a, b in got["account"]] == ["f4fddc3c96e5", "DE89370400440532013000"]


def test_cues_in_any_form_and_validated_values():
    found = lambda t: [t[a:b] for a, b in pii.find_spans(t, AUTO)["account"]]
    for cue in ("API key: ", "Api_Key=", "apiKey: ", "api-key ", "Authorization: Bearer ", "PASSWORD is ", "access_key='", "aCCount No. "):
        assert found(f"x {cue}ab12cd34ef z") == ["ab12cd34ef"], cue
    assert found("IBAN DE89 3704 0044 0532 0130 00 and more") == ["DE89 3704 0044 0532 0130 00"]
    assert found("IBAN: XX00000000, IBAN DE88 3704 0044 0532 0130 00") == []
    assert found("SSN 123-45-6789, ssn: 000-12-3456, ssn 666-12-3456, ssn 987-65-4321, SSN: 123-00-4567") == ["123-45-6789"]
    assert found("account " + "1" * 40) == [] and found("token nothing here") == []
    assert found("\u0130 token ab12cd") == ["ab12cd"]  # a letter whose lower case is two characters


def test_long_texts_take_time_in_proportion():
    for text in ("token" * 200_000, "token " * 100_000, "iban de" * 100_000, "ssn 1" * 100_000, "a://" * 100_000, "1.2." * 100_000, "+1" * 100_000, "a@" * 100_000):
        start = time.process_time()
        pii.find_spans(text, AUTO)
        assert time.process_time() - start < 10, text[:10]


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "x@y.zz"), (3, "x@y.zz"), (None, "1.2.3.4"), (5, "a" * 200_000 + "@b.c" + "9" * 200_000)]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, n_email int, spans string")
    got = pii.personal_data(df).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].base_sha256 == by[2].base_sha256 == empty and by[1].spans == ""
    assert by[3].n_email == 1 and by[3].spans == "email:0:6" and by[None].spans == "ip:0:7" and by[5].n_email == 1
    assert pii.personal_data(df.limit(0)).count() == 0
    assert [r.text for r in pii.redact(df.filter("doc_id = 3")).collect()] == ["<email>"] * 2
