"""Fill-in-middle, the Jaccard join and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tastemill.llm import collocations, fill_middle, jaccard_join
from tastemill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"
MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_cut(doc_id, text):
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    random.seed(4)
    signs = "ab <>PSM/\n\t.é😀́"
    made = ["".join(random.choice(signs) for _ in range(random.randrange(0, 40))) for _ in range(300)]
    return made + ["x" * 40_000, "<P>", "a<S>b", "<", "<<P", "\r\n", "", None, "same", "same"]


@pytest.fixture(scope="module")
def middle_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate(some_texts())] + [(None, "no id", None), (None, None, None), (3, "again", "en")]
    clashing = {c: F.lit(1) for c in ("n", "form", "output", "key", "gram", "a")}
    return rows, spark.createDataFrame(rows, SCHEMA).withColumns(clashing).repartition(3)


@pytest.mark.parametrize("most", [500_000, 7])
def test_texts_are_cut_and_put_back(middle_rows, most, monkeypatch):
    rows, frame = middle_rows
    monkeypatch.setattr(fill_middle, "MOST_UNITS", most)
    fill_middle._patterns.cache_clear()
    found = fill_middle.fill_in_middle(frame).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    expected = [(i, *brute_cut(i, t or ""), t or "") for i, t, _ in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame.limit(0)).isEmpty()


def test_other_units_and_marks(spark):
    fill_middle._patterns.cache_clear()
    frame = spark.createDataFrame([(i, "one\ntwo\n" * i + "three") for i in range(40)], "doc_id long, text string")
    made = fill_middle.fill_in_middle(frame, unit=r"[^\n]*\n|[^\n]+", plain_from=100, spm_below=50, marks=("[p]", "[s]", "[m]"))
    back = fill_middle.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))
    for r in made.withColumn("back", back).collect():
        assert r.n == 2 * r.doc_id + 1 and r.back == "one\ntwo\n" * r.doc_id + "three"
        if r.form != "plain":
            assert r.back[: r.prefix_chars][-1:] in ("", "\n") or r.prefix_chars == len(r.back)
    # Units that don't cover a text leave it plain.
    assert fill_middle.fill_in_middle(frame, unit="[a-z]").where("form <> 'plain' and doc_id > 0").isEmpty()
    for marks in [("<a", "a>", "b"), ("aa", "b", "c"), ("", "a", "b"), ("a", "a", "b")]:
        with pytest.raises(ValueError):
            fill_middle.check_marks(marks)
    fill_middle.check_marks(MARKS)


def brute_set(text, words=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_groups(rows):
    sets = {s: None for _, t in rows if (s := brute_set(t))}
    names = list(sets)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            both = len(a & names[j])
            if 100 * both >= 85 * (len(a) + len(names[j]) - both):
                root[find(i)] = find(j)
    place, least = {s: find(i) for i, s in enumerate(names)}, {}
    for i, t in rows:
        if i is not None and (s := brute_set(t)):
            least[place[s]] = min(i, least.get(place[s], i))
    return [str((i, len(s := brute_set(t)), least.get(place[s]) if s else i)) for i, t in rows]


def similar_rows():
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    made = []
    for size in [2, 4, 5, 7, 10, 12, 23, 40, 90, 200]:
        for _ in range(3):
            base = [word() for _ in range(size)]
            made.append(" ".join(base))
            for _ in range(6):
                near = base[: round(size * random.uniform(0.8, 1))] + [word() for _ in range(random.choice([0, 0, 1, size // 20]))]
                for _ in range(random.choice([0, 0, 1, 1, 2])):
                    near[random.randrange(len(near))] = word()
                made.append(" ".join(near).upper() if random.random() < 0.2 else " ".join(near))
    # A dense group around one text, whose members lie at about the radius of each other.
    centre = [word() for _ in range(150)]
    for _ in range(60):
        near = list(centre)
        for _ in range(random.randrange(0, 6)):
            near[random.randrange(150)] = word()
        made.append(" ".join(near))
    # A passage that many share.
    made += [f"{' '.join(centre[:40])} {' '.join(word() for _ in range(random.randrange(5, 60)))}" for _ in range(30)]
    made += ["", None, " \t\n", "one", "ONE", "two words", made[5], made[5], "the " * 300, "the " * 90, "the the the the"]
    return list(enumerate(made)) + [(None, "no id"), (None, None), (4, made[4]), (4, made[4]), (4, "other")]


@pytest.mark.parametrize("leaf,pivots", [(2_000_000, 32), (900, 4), (120, 3)])
def test_similar_sets(spark, leaf, pivots):
    rows = similar_rows()
    clashing = {c: F.lit(1) for c in ("key", "cell", "shingles", "n", "component_id")}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing).repartition(5)
    found = jaccard_join.similar_sets(frame, leaf=leaf, pivots=pivots).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == sorted(brute_groups(rows))
    assert jaccard_join.similar_sets(frame.limit(0)).isEmpty()


def brute_phrases(rows, least, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rows_of = []
        often = {g: a for g, a in f.items() if a >= least}
        for g, a in often.items():
            if len(g) < 2:
                continue
            inside = any(
                len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in often.items()
            )
            if not inside:
                n = total[lang]
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows_of.append((-score, -a, " ".join(g).encode(), a, f[g[:k]], f[g[k:]], n))
        for rank, (s, _, g, a, left, right, n) in enumerate(sorted(rows_of)[:top], 1):
            out.append(str((lang, rank, g.decode(), a, left, right, n, -s)))
    return sorted(out)


@pytest.mark.parametrize("bits", [27, 6])
def test_collocations(spark, bits):
    random.seed(6)
    words = ["the", "of", "a", "New", "york", "é", "😀", "x\x1fy", "<b>", "to"]
    made = [("".join(random.choice(words) + random.choice("    \t.,\n\r;") for _ in range(random.randrange(0, 60))), random.choice(["en", "fr", None])) for _ in range(300)]
    made += [("in as much as possible the " * 8, "en"), ("the " * 50, "und"), (None, "en"), ("", None), ("word" * 2_000, "x"), ("so called. So Called", "x")]
    frame = spark.createDataFrame(made, "text string, lang string").withColumn("gram", F.lit(1)).repartition(3)
    for least in (8, 2):
        found = collocations.collocations(frame, least=least, bits=bits)
        expected = brute_phrases(made, least)
        assert sorted(str(tuple(r)) for r in found.collect()) == expected
    assert len(expected) > 100
    few = collocations.collocations(frame, least=2, top=3, bits=bits)
    assert sorted(str(tuple(r)) for r in few.collect()) == brute_phrases(made, 2, 3)
    assert collocations.collocations(frame.limit(0)).isEmpty()


def test_queries_of_whole_tables(spark, folder):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = []
    for i, t, _ in docs:
        n, form, p, m, out = brute_cut(i, t or "")
        expected.append(str((i, n, form, p, m, sha(out), sha(t or ""))))
    assert sorted(str(tuple(r)) for r in QUERIES["op11_fill_in_middle"](spark, folder).collect()) == sorted(expected)
    found = QUERIES["op12_jaccard_join"](spark, folder).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(brute_groups([(i, t) for i, t, _ in docs]))
    found = QUERIES["op13_collocations"](spark, folder).collect()
    assert sorted(str(tuple(r)) for r in found) == brute_phrases([(t, lang) for _, t, lang in docs], 100)
