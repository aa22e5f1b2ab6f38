from __future__ import annotations

import hashlib
import random
import re

from tallyframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The base kinds by their patterns as they stand."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and _luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def _luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_base_spans_match_the_patterns_on_random_text():
    rng = random.Random(5)
    bits = ["4539148803436467", "10.0.0.1", "255", ".", "@", "a.b@c", "@x.y", "+1", " ", "-", "(", ")", "é", "9", "256", "z", "1.2.3", "+49 30 1234567", "%+_", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in pii.spans_of(t) if s[4]] == plain(t), t


def test_checksums_and_context():
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    assert [s[0] for s in pii.spans_of("IBAN DE89 3704 0044 0532 0130 00 thanks")] == ["iban"]
    assert [s[0] for s in pii.spans_of("my ssn 123-45-6789")] == ["national_id"]
    assert pii.spans_of("part 123-45-6789") == []
    near, far = (pii.spans_of(f"{w} 4539148803436467")[0][3] for w in ("card", "order"))
    assert near > far
    assert [s[0] for s in pii.spans_of("visa card 378282246310005")] == ["short_card"] and pii.spans_of("no. 378282246310005") == []


def test_long_texts_take_time_in_proportion():
    for t in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "@" * 500_000, "+1(" * 300_000, "a.b" * 300_000 + "@"):
        pii.spans_of(t)


def test_digest_and_redaction(spark, docs, no_docs):
    rows = pii.digest(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] != 10}
    for r in rows:
        if r["doc_id"] in texts:
            want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain(texts[r["doc_id"]] or ""))
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert r["spans"].startswith(want)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    seven = clean.filter("doc_id = 7").first()
    assert "[EMAIL]" in seven["text"] and "@" not in seven["text"] and seven["n_chars"] == len(seven["text"])
    assert clean.filter("text is null").count() == 1
    assert pii.digest(no_docs).count() == 0


def test_words_behind_a_span_count():
    kinds = lambda t: [k for k, *_ in pii.spans_of(t)]
    assert kinds("123-45-6789 is the social security number") == ["national_id"]
    assert kinds("123-45-6789 " + "x" * 40 + " social security") == []


def iban_of(country, length, seed):
    """A number of the country that mod-97 confirms."""
    body = "".join(random.Random(f"{country}{seed}").choices("0123456789", k=length - 4))
    digits = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def test_ibans_of_every_country():
    for country, length in [*pii.IBAN_LENGTH.items(), ("ZZ", 15), ("ZQ", 34), ("QQ", 21)]:
        number = iban_of(country, length, 1)
        for text in (number, number.lower(), " ".join(number[i : i + 4] for i in range(0, length, 4))):
            assert ("iban", 5, 5 + len(text)) in [s[:3] for s in pii.spans_of(f"IBAN {text}, bank account")], (country, text)
        wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
        assert "iban" not in [s[0] for s in pii.spans_of(f"IBAN {wrong}, bank account")]
    # a start that fails does not swallow the number behind it
    good = iban_of("DE", 22, 2)
    assert [s[:3] for s in pii.spans_of(f"AB12 {good} END")] == [("iban", 5, 27)]
