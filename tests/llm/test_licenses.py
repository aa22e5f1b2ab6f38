from __future__ import annotations

import random
import re
from collections import Counter

from tallyframe.llm import licenses


def slow(text, texts=licenses.TEMPLATES):
    """Every window of every admitted size, by multisets."""
    best = (0.0, None)
    a = licenses.template_bigrams(text or "")
    for name, t in texts:
        b = licenses.template_bigrams(t)
        sizes = list(licenses.size_bounds(len(b), 0.8))
        if len(a) < min(sizes) or 2.0 * (Counter(a) & Counter(b)).total() < 0.8 * (len(b) + min(sizes)):
            continue
        for s in {min(s, len(a)) for s in sizes}:
            for at in range(len(a) - s + 1):
                d = 2.0 * (Counter(a[at : at + s]) & Counter(b)).total() / (len(b) + s)
                if d >= 0.8 and (d > best[0] or (d == best[0] and name < best[1])):
                    best = (d, name)
    return best


EXTRA = [
    "LICENSED### under$$$ the Apache License!! Version 2.0", "This work is licensed under the GNU General Public License version 3 now", "of of of of of of", "Licensed under CC BY 4.0.", "license",
    "x y\n\n" + licenses.TEMPLATES[1][1].replace(" to ", "\n# to ") + "\n\nmore", "said: this code is released under the MIT License, see below. " * 3, licenses.TEMPLATES[1][1] + "\n" + licenses.TEMPLATES[0][1],
]


def with_extra(spark, docs):
    return docs.unionByName(spark.createDataFrame([(60 + i, t, "en", "s", 1, 0, "x", 0.1) for i, t in enumerate(EXTRA)], docs.schema))


def test_against_brute_force(spark, docs):
    short = [t for t in licenses.TEMPLATES if len(t[1]) < 400]
    all_ = with_extra(spark, docs).filter("length(text) < 5000 or text is null")
    want = sorted(((r["doc_id"], slow(r["text"], short)[1], slow(r["text"], short)[0]) for r in all_.collect()), key=str)
    got = sorted(((r["doc_id"], r["license"], r["dice"]) for r in licenses.scan(all_, texts=short).collect()), key=str)
    assert got == want
    assert {r[1] for r in got} >= {None, "MIT", "Apache-2.0", "GPL-3.0"}


def test_whole_licences_are_found_wherever_they_stand(spark):
    """Recall over all templates: wrapped, behind comment marks, amid other words, slightly changed."""
    rng = random.Random(4)
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 40:  # one word in thirty is another
            words = [w if rng.random() > 1 / 30 else "whatever" for w in words]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        for j, mark in enumerate(("\n", "\n * ", "\n\n# ", " ")):
            other = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(rng.randint(0, 200)))
            rows.append((10 * i + j, other + mark + mark.join(lines) + "\nCopyright (c) 2020 " + other))
            want[10 * i + j] = name
    rows.append((9999, "the software is provided for the use of the author and the copyright holder " * 50))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(got[i]["license"] == name for i, name in want.items())
    assert right >= 0.95 * len(want), [(i, want[i], got[i]["license"]) for i in want if got[i]["license"] != want[i]]
    assert got[9999]["license"] is None


def test_plan_has_no_python(spark, docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sizes():
    assert list(licenses.size_bounds(4, 0.8)) == [3, 4, 5, 6] and list(licenses.size_bounds(160, 0.8)) == list(range(107, 241))
    assert all(re.search(r"\w", t) for _, t in licenses.TEMPLATES)


def test_empty_and_very_long(spark, no_docs):
    assert licenses.scan(no_docs).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000 + "Released under the MIT License. " + "of the " * 100_000)], "doc_id long, text string")
    assert licenses.scan(long).first()["license"] == "MIT"


def test_a_long_notice_with_words_put_in_is_found_by_its_best_window(spark):
    """Words inserted and replaced: the reported Dice is that of the best window of all admitted sizes."""
    rng, (name, text) = random.Random(11), licenses.TEMPLATES[1]
    rows = []
    for i in range(60):
        words = text.split()
        for _ in range(rng.randint(5, 11)):
            words.insert(rng.randrange(len(words)), rng.choice(["lorem", "ipsum"]))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "whatever"
        rows.append((i, "before that " * rng.randint(0, 9) + " ".join(words)))
    want = [(i, *reversed(slow(t, [(name, text)]))) for i, t in rows]
    assert any(0.8 <= d < 0.82 for _, _, d in want)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts=[(name, text)])
    assert sorted((r["doc_id"], r["license"], r["dice"]) for r in got.collect()) == want
