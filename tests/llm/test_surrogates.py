"""Surrogates against brute force: distinctness, coreference, formats, long texts."""

import random
import re

from docloom.llm import pii


def done(spark, texts):
    rows = list(enumerate(texts))
    got = pii.pseudonymised(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, row string")).select("row.doc_id", "row.text").collect()
    return [t for _, t in sorted((r["doc_id"], r["text"]) for r in got)]


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_long_texts_and_names(spark):
    texts = ["x@" + "a." * 20_000 + "!", "mail a@" + "b." * 300 + "com now", "DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", "DE11 3704 0044 0532 0130 00",
             "Priya Natarajan wrote to Kwame Mensah; Dr. Olga Petrova met MR. JOHN SMITH", "Dear Priya Natarajan, JOHN SMITH is here", "The Old House and New Street"]
    out = done(spark, texts)
    assert out[0] == texts[0] and out[6] == texts[6]
    ibans = re.findall(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})+(?: ?[A-Z0-9]{1,3})?", out[2])
    assert len(ibans) == 2 and all(mod97(i) == 1 for i in ibans) and ibans[0][:2] == "DE" and "3704" not in out[2] and mod97(out[3]) != 1
    for name in ("Priya", "Natarajan", "Kwame", "Mensah", "Olga", "Petrova", "JOHN", "SMITH"):
        assert name not in out[4] + out[5], name
    assert out[4].split()[:2] == out[5].rstrip().split()[1:3][:1] + [out[5].split()[2].rstrip(",")] and "MR. " in out[4]
    assert out[4].split("MR. ")[1].split()[0].isupper()


def test_used_up_forms(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"to {a}@{b}.com" for a in letters for b in letters]
    out = [t.split()[1] for t in done(spark, texts)]
    assert len(set(out)) == 676 and not set(out) & {t.split()[1] for t in texts} and all(re.fullmatch(r"[a-z]+@[a-z]\.com", x) for x in out)


def test_distinct_and_equal(spark):
    rng = random.Random(2)
    made = [f"{rng.choice('abc')}{rng.randint(0, 40)}@mail{rng.randint(0, 3)}.org" for _ in range(300)] + [f"10.{rng.randint(0, 3)}.0.{rng.randint(0, 9)}" for _ in range(100)]
    out = [t.split()[1] for t in done(spark, [f"at {x} there" for x in made])]
    to = {}
    for a, b in zip(made, out):
        assert to.setdefault(a, b) == b and b not in made
    assert len(set(to.values())) == len(to)
