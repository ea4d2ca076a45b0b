"""The text operators against brute force, on small tables with awkward rows."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import bpe, chat, components, decontaminate, html_blocks, pii, quality, shingles, simhash, substrings
from tastemill.llm import syncmers, url_rules
from tastemill.llm.queries import QUERIES, VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPECIAL = "<|endoftext|>"


def texts():
    random.seed(7)
    words = [random.choice("bcdfg") + random.choice("aeiou") + random.choice("lmnrs") for _ in range(400)]
    made = [" ".join(random.choice(words) for _ in range(random.randrange(0, 90))) for _ in range(30)]
    passage = " ".join(random.choice(words) for _ in range(60))
    made += [f"{made[0]} {passage} x{i} {passage[: 50 * i]}" for i in range(4)]
    long = " ".join(random.choice(words) for _ in range(4_000))
    made += [long, long.replace(words[3], "edited", 1), made[1], made[1], "the " * 80, " \n\t ", "", None]
    made += [f"mail a.b@c.de or +1 (273) 555-4135 from 10.0.0.255 {SPECIAL} é😀 4111 1111 1111 1111."]
    made += [f'token = "{hashlib.md5(str(i).encode()).hexdigest()}" {passage}' for i in range(5)] + ['token = "zq1x9w"']
    return made


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    return made + [made[2], made[2], (None, "no id here", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def documents(spark, rows):
    clashing = {c: F.lit(1) for c in ("fp", "key", "score", "component_id", "window", "fingerprint", "label")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clashing).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, columns):
    return sorted(map(str, ((r.doc_id, *[r[c] for c in columns]) for r in df.collect())))


def test_bpe_equals_the_library(documents, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    expected = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append(str((row[0], len(ids), digest, hashlib.sha256(back.encode()).hexdigest())))
    found = bpe.encode_documents(documents, VOCABULARY)
    assert by_row(found, ["n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(expected)
    assert bpe.encode_documents(none, VOCABULARY).count() == 0


def test_bpe_of_long_and_odd_pieces():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    random.seed(3)
    odd = ["a" * 3_000, "ab" * 900 + "!" * 70, " " * 300, "\x1c\x85\u3000 x", SPECIAL * 3, "I'll WE'LL ½² 日本"]
    odd += ["".join(chr(random.choice([random.randrange(1, 0x300), random.randrange(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(300)]
    for text, ids in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == text


def brute_repeats(rows, span):
    counts = {}
    for row in rows:
        words = substrings.words_of(row[1])
        for i in range(len(words) - span + 1):
            window = tuple(words[i : i + span])
            counts[window] = counts.get(window, 0) + 1
    for row in rows:
        words = substrings.words_of(row[1])
        removed = [False] * len(words)
        for i in range(len(words) - span + 1):
            if counts[tuple(words[i : i + span])] > 1:
                removed[i : i + span] = [True] * span
        kept = b" ".join(w for w, r in zip(words, removed) if not r)
        yield str((row[0], len(words), sum(removed), hashlib.sha256(kept).hexdigest()))


@pytest.mark.parametrize("span", [35, 12])
def test_repeated_windows_are_cut(documents, rows, none, span):
    found = substrings.without_repeats(documents, span=span, k=5, keep_text=span == 12)
    assert by_row(found, ["n_words", "n_removed", "kept_sha256"]) == sorted(brute_repeats(rows, span))
    assert substrings.without_repeats(none).count() == 0


def brute_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components_of_chains_stars_and_cycles(spark):
    random.seed(5)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(200, 230)] + [(1, 2), (2, 3), (3, 1), (9, 9)]
    pairs += [(random.randrange(500, 700), random.randrange(500, 700)) for _ in range(90)]
    found = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.u: r.v for r in found} == {x: y for x, y in brute_components(pairs).items() if x != y}


@pytest.mark.parametrize("bucket_rows", [8_192, 64])
def test_close_fingerprints_are_joined(spark, bucket_rows):
    random.seed(11)
    centre = random.getrandbits(64)
    fps = {random.getrandbits(64) for _ in range(200)}
    for _ in range(700):
        near = centre
        for bit in random.sample(range(64), random.randrange(0, 5)):
            near ^= 1 << bit
        fps.add(near)
    fps = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.close_links(spark.createDataFrame(signed, "fp long"), bucket_rows=bucket_rows).collect()
    found = brute_components([(r.a % (1 << 64), r.b % (1 << 64)) for r in links])
    assert found == brute_components(pairs)


def test_simhash_components(documents, rows, none):
    found = simhash.near_duplicates(documents).collect()
    fps = [(r.doc_id, int(r.fingerprint, 16)) for r in found]
    assert sorted(str((i, f)) for i, f in fps) == sorted(str((r[0], simhash.fingerprint(r[1]))) for r in rows)
    links = [(a, b) for _, a in fps for _, b in fps if (a ^ b).bit_count() <= 3]
    root = brute_components(links)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[int(r.fingerprint, 16)]) for r in found)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    assert kept.where("doc_id is not null").count() == len(set(least.values()))


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("part_shingles", [1_000_000, 500])
def test_groups_of_similar_shingles(spark, documents, rows, none, part_shingles):
    random.seed(13)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    made = []
    for i in range(60):
        base = [word() for _ in range(random.choice([3, 6, 12, 18, 60, 200]))]
        made.append(base)
        for _ in range(4):
            # From about 0.6 to 1: words cut at the end, and a few changed.
            near = base[: round(len(base) * random.uniform(0.75, 1))]
            for _ in range(random.choice([0, 0, 1, 2])):
                near[random.randrange(len(near))] = word()
            made.append(near)
    every = [(r[0], r[1]) for r in rows] + [(1000 + i, " ".join(w)) for i, w in enumerate(made)]
    frame = documents.select("doc_id", "text").unionByName(spark.createDataFrame(every[len(rows) :], "doc_id long, text string"))
    sets = {t: five_words(t) for _, t in every}
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    names = sorted(sets, key=str)
    root = brute_components([(names.index(a), names.index(b)) for a in names for b in names if like(sets[a], sets[b])])
    least = {}
    for i, t in every:
        if i is not None:
            least[root[names.index(t)]] = min(i, least.get(root[names.index(t)], i))
    found = shingles.similar_groups(frame, part_shingles=part_shingles).collect()
    expected = [str((i, least.get(root[names.index(t)]))) for i, t in every]
    assert sorted(str((r.doc_id, r.component_id)) for r in found) == sorted(expected)
    assert shingles.similar_groups(none).count() == 0
    kept = shingles.one_of_each_group(frame.withColumn("root", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))


def test_near_duplicate_stage_of_short_and_edited_texts(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(120)]
    edited = [w if i not in (20, 70) else "other" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(edited), " ".join(words[:18]), " ".join(words[:17]), " ".join(words[40:55])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # 0 and 1 share 0.84 of their shingles in the middle of the text, 2 and 3 are short.
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_near_duplicate_stage_takes_simhash_groups(spark):
    import corpus_pipeline

    random.seed(17)
    words = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(1_200)]
    edited = [w + "x" if i % 36 == 0 else w for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(edited), " ".join(words[::-1])]
    fingerprints = [simhash.fingerprint(t) for t in texts]
    assert (fingerprints[0] ^ fingerprints[1]).bit_count() <= 3 < (fingerprints[0] ^ fingerprints[2]).bit_count()
    first, second = map(five_words, texts[:2])
    assert len(first & second) < 0.8 * len(first | second)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def brute_hits(rows, items, window):
    windows = {}
    for item, text in items:
        words = decontaminate.words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    for row in rows:
        words, hit, found = decontaminate.words_of(row[1]), set(), set()
        for size in set(map(len, windows)):
            for i in range(len(words) - size + 1):
                if items := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= items
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield str((row[0], len(words), len(hit), len(found), digest, bool(hit)))


def test_contamination(spark, documents, rows, none):
    all_texts = texts()
    items = [(i, " ".join((all_texts[i] or "").split()[3:30])) for i in range(8)]
    items += [(20, "EDITED"), (21, "x2"), (22, ""), (23, None), (24, all_texts[35][:300]), (24, all_texts[35][:300]), (25, "the the the")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = sorted(brute_hits(rows, items, 10))
    assert by_row(decontaminate.contamination(documents, benchmark), columns) == expected
    assert by_row(decontaminate.contamination(documents, benchmark, block_words=20), columns) == expected
    assert decontaminate.contamination(documents, benchmark.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.contamination(none, benchmark).isEmpty()
    clean = decontaminate.decontaminated(documents, benchmark)
    assert clean.columns == documents.columns
    assert decontaminate.contamination(clean, spark.createDataFrame([items[8]], "item_id long, text string")).where("contaminated").isEmpty()


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(number):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data(spark, documents, rows, none):
    random.seed(2)
    signs = list("0123456789") * 3 + list("a.@-+ ()%_é😀B")
    odd = [(1000 + i, "".join(random.choice(signs) for _ in range(random.randrange(0, 80)))) for i in range(800)]
    odd += [(9001, "a" * 50_000 + "@x.y"), (9002, "4111111111111111 " * 1_500), (9003, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1")]
    every = documents.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    expected = [(r[0], hashlib.sha256(",".join(brute_spans(r[1] or "")).encode()).hexdigest()) for r in [*rows, *odd]]
    found = pii.personal_data(every).collect()
    assert sorted(str((r.doc_id, r.base_sha256)) for r in found) == sorted(map(str, expected))
    # The short value has no format of its own; its context gives it away.
    last = next(r for r in found if r.doc_id == len(texts()) - 1)
    assert last.n_secret == 1 and last.spans == "secret:9:15"
    assert pii.personal_data(none).count() == 0
    clean = pii.redacted(documents)
    assert clean.columns == documents.columns and clean.count() == len(rows)
    assert pii.personal_data(clean).where("n_email + n_ip + n_card + n_phone + n_secret > 0").isEmpty()


def test_syncmers(documents, rows, none):
    found = syncmers.edited_fingerprints(documents).collect()
    assert len(found) == len(rows)
    order = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, key=lambda r: -r[0])
    digest = {r.doc_id: r.edited_sha256 for r in found}
    for (i, text), (_, following) in zip(order, order[1:]):
        half = len(text) // 2
        assert digest[i] == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
    same = {}
    for r in found:
        assert same.setdefault(next(x[1] or "" for x in rows if x[0] == r.doc_id) if r.doc_id is not None else r.fingerprint, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert next(r for r in found if r.n_chars > 10_000).near_edited > 0.2
    spark = documents.sparkSession
    flat = documents.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word"))
    hashes = {r.word: r.hash for r in flat.distinct().withColumn("hash", F.xxhash64("word")).collect()}
    chosen = {}

    def brute(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        if len(words) < syncmers.K:
            return {tuple(words)} if words else set()
        h = [hashes[w] for w in words]
        at = [i for i in range(len(h) - 3) if min(h[i], h[i + 3]) <= min(h[i + 1 : i + 3])]
        chosen[text] = at
        return {(*words[i : i + 4], (at[n + 1 :] or [i])[0] - i) for n, i in enumerate(at)}

    near = {r.doc_id: r for r in found}
    for (i, text), (_, following) in zip(order, order[1:]):
        a, b = brute(text), brute(following)
        assert len(near[i].fingerprint) == 16 * len(a)
        assert near[i].near_next == round(len(a & b) / len(a | b), 6) if a | b else near[i].near_next == 1
    places = {}
    for r in syncmers.anchor_table(documents.where("doc_id is not null").dropDuplicates()).collect():
        places.setdefault(r.doc_id, []).append(r.start)
    assert all(sorted(places.get(i, [])) == chosen[text] for i, text in order if text in chosen)
    passage = " ".join(f"w{i}" for i in range(60))
    pair = [(1, f"a b c d e f g {passage} h i j"), (2, f"k l {passage} m n o p q"), (3, "r s t u")]
    spans = syncmers.shared_spans(
        spark.createDataFrame(pair, "doc_id long, text string"),
        spark.createDataFrame([(1, 2), (1, 3), (None, 1)], "left_id long, right_id long"),
    ).collect()
    assert {(r.left_id, r.right_id) for r in spans} == {(1, 2)} and max(r.n_words for r in spans) >= 45
    assert all(7 <= r.left_start and r.right_start == r.left_start - 5 for r in spans if r.n_words > 8)
    assert syncmers.edited_fingerprints(none).count() == 0


def test_quality_against_labels(spark, none):
    folder = "/root/testdata/sf0.01"
    scored = quality.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    # The labels were never used in fitting.
    wrong, n = scored.join(labels, "doc_id").agg(F.sum((F.col("keep") != (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert wrong <= 0.02 * n
    assert quality.quality_scores(none).count() == 0 and quality.good_documents(none).count() == 0


def test_toxic_texts_are_told_from_clean_ones(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("aeioulmnrst") for _ in range(6))
    made = []
    for i in range(240):
        words = ["the", "of", "and"] * 10 + [word() for _ in range(60)]
        # No list of insults has the word of the second kind; only labels tell it.
        words += [[], ["idiot,", "Stupid"], ["grumblo", "zwackel", "grumblo"]][i % 3]
        random.shuffle(words)
        made.append((i, " ".join(words), int(i % 3 > 0)))
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    labels = frame.where("doc_id < 160").select("doc_id", "toxic")
    found = {r.doc_id: r for r in quality.quality_scores(frame.drop("toxic"), labels).collect()}
    assert all(found[i].toxic == bool(t) for i, _, t in made)
    listed = {r.doc_id: r.toxic for r in quality.quality_scores(frame.drop("toxic")).collect()}
    assert all(listed[i] for i in range(1, 240, 3)) and not any(listed[i] for i in range(0, 240, 3))
    kept = quality.good_documents(frame.drop("toxic"), labels)
    assert kept.columns == ["doc_id", "text"] and not any(r.doc_id % 3 for r in kept.collect())


def test_quality_of_awkward_rows(documents, rows):
    scored = quality.quality_scores(documents)
    assert scored.count() == len(rows) and scored.where("score is null").isEmpty()
    assert quality.good_documents(documents).columns == documents.columns


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var a="</p>";</script></head><body><header>top</header>
<nav><ul><li><a href=/a>the menu</a></ul></nav><div class="cookie-notice">the notice of the site</div><div class="ad">buy</div>
<article><header><h1>A title</h1></header><p>First &amp; <b>bold</b>\n text<br>goes &lt;on&gt;<p>Short.<div class="ad">the advert</div>
<ul><li>one<li>two</ul><form><input>mail<button>go</button></form><!-- <p>no --><section class="comments"><p>the comment</p></section></article>
<aside>side</aside><footer>&copy; the end</footer>"""


def test_main_text(spark):
    assert html_blocks.main_text(PAGE) == "A title\n\nFirst & bold text goes <on>\n\nShort.\n\none\n\ntwo"
    prose = "the house of the people is in the town and it was built for all of them to live in as they like to do on days of rest and of work"
    plain = f"<body><div><a href=x>home</a> <a href=y>about</a></div><p>{prose} {prose}</p><p>Short one.</p><p>{prose}</p><div><a>x</a></div>"
    assert html_blocks.main_text(plain) == f"{prose} {prose}\n\nShort one.\n\n{prose}"
    odd = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<<a 'x <p"), (4, "x", "<p>" * 5_000)]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = html_blocks.extracted(pages).collect()
    assert sorted(str((r.page_id, r.text, r.n_chars)) for r in found) == sorted(str((i, t := html_blocks.main_text(h), len(t))) for i, _, h in odd)
    assert html_blocks.extracted(pages.limit(0)).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_rules.RULES if (host == (own := r[: r.index("/")]) or host.endswith("." + own)) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    urls = [None, "", "//org/", "HTTP://A.EXAMPLE.ORG/es/1", "x://org", "x://org/", "a://b://org/", "http://borg/", "http://org?x=/"]
    urls += ["http://x.com/fr/é?q#f", "http://example.org/en/1", "http://example.org/en/2", "x://", "http://org/", "http://org/"]
    urls += [f"http://s{i}.com/de/{i}" for i in range(30)] + [f"http://s{i}.net/de/{i}?x=1" for i in range(9)] + [f"http://s{i}.com/fr/{i}" for i in range(30)]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    found = url_rules.url_verdicts(pages).collect()
    assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in found) == sorted(str((i or None, *brute_rule(u))) for i, u in enumerate(urls))
    for r in found:
        if r.rule:
            assert r.verdict == url_rules.RULES[r.rule]
        elif r.host.endswith(".net"):
            assert r.verdict == "block" and r.mined_rule and r.confidence >= 0.8
    assert url_rules.url_verdicts(pages.limit(0)).count() == 0


def test_labelled_urls_teach_rare_hosts(spark):
    urls = [f"http://casino-win.net/en/{i}" for i in range(40)] + [f"http://news{i % 50}.net/en/{i}" for i in range(4_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = pages.where("page_id % 2 = 0").select("url", F.when(F.col("url").contains("casino"), "block").otherwise("allow").alias("label"))
    labels = labels.unionByName(spark.createDataFrame([(None, "block"), ("http://x.net/", "unknown")], "url string, label string"))
    found = url_rules.url_verdicts(pages, labels=labels, least_rows=15).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == set(range(40))
    # A share leaves such a host out.
    assert {r.verdict for r in url_rules.url_verdicts(pages, labels=labels).collect()} == {"allow"}


def test_tool_calls(spark):
    schemas = spark.createDataFrame(
        [("find", "q", "string", True), ("find", "n", "integer", False), ("ask", "it", "object", True)],
        "name string, parameter string, type string, required boolean",
    )
    calls = [
        {"id": "b", "name": "find", "arguments": {"q": "x", "n": 3}, "after": ["a"]},
        {"id": "a", "name": "find", "arguments": {"q": 1}},
        {"id": "c", "name": "ask", "arguments": {"it": {"z": 1, "a": [1, 2]}}, "after": ["b", "unknown"]},
    ]
    cycle = [{"id": "x", "name": "find", "arguments": '{"q": "s"}', "after": ["y"]}, {"id": "y", "name": "no", "arguments": {}, "after": ["x"]}]
    messages = [
        (1, 0, "user", 'hi "x" é\n'),
        (1, 1, "assistant", json.dumps({"tool_calls": calls})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": 2}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "q", "content": "no"})),
        (2, 0, "assistant", json.dumps({"tool_calls": cycle})),
        (3, 0, "assistant", "{bad"),
        (3, 0, "assistant", "{bad"),
        (None, None, None, None),
    ]
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    found = chat.formatted(frame, schemas).collect()
    by_call = {(r.conv_id, r.role, r.call_id): (r.depth, r.linked, r.valid, r.position) for r in found if r.call_id}
    assert by_call == {
        (1, "assistant", "a"): (0, False, False, 1),
        (1, "assistant", "b"): (1, True, True, 2),
        (1, "assistant", "c"): (2, False, True, 3),
        (1, "tool", "b"): (None, True, None, 1),
        (1, "tool", "q"): (None, False, None, 1),
        (2, "assistant", "x"): (None, False, True, 1),
        (2, "assistant", "y"): (None, False, False, 2),
    }
    for r in found:
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    plain = next(r for r in found if r.conv_id == 1 and r.turn == 0)
    assert json.loads(plain.json) == {"role": "user", "content": 'hi "x" é\n'}
    assert sum(r.conv_id == 3 for r in found) == 2 and len(found) == 11
    assert chat.formatted(frame.limit(0), schemas).count() == 0


def test_odd_argument_names(spark):
    names = ["it's", 'say "x"', "a]b", "c.d", "e\\f", "$['g']", "", "é😀", "['", "null"]
    schemas = [("find", n, "string", False) for n in names] + [("find", "n", "number", True), ("other", "x", "null", False)]
    schemas = spark.createDataFrame(schemas, "name string, parameter string, type string, required boolean")
    arguments = [{n: "x", "n": 1.5e3} for n in names] + [{n: 1, "n": 1} for n in names] + [{"n": "1"}, {"n": None}, [], "text", None, {"N": 1}]
    calls = [{"id": f"{i:03}", "name": "find", "arguments": a} for i, a in enumerate(arguments)] + [{"id": "z", "name": "other", "arguments": {"x": None}}]
    frame = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id long, turn long, role string, text string")
    found = {r.call_id: r.valid for r in chat.formatted(frame, schemas).collect()}
    assert found == {f"{i:03}": i < len(names) for i in range(len(arguments))} | {"z": False}


def brute_depths(calls):
    after = {}
    for c, i, needs in calls:
        after.setdefault((c, i), set()).update(needs)
    after = {(c, i): {(c, n) for n in needs if (c, n) in after} for (c, i), needs in after.items()}
    depth = {}
    while ready := {k for k in after if k not in depth and all(n in depth for n in after[k])}:
        depth |= {k: max((depth[n] + 1 for n in after[k]), default=0) for k in ready}
    return depth


def test_depths_of_long_chains_and_any_graph(spark):
    random.seed(9)
    calls = [(0, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(2_000)]
    for c in range(1, 60):
        size = random.randrange(1, 14)
        for i in range(size):
            # Now and then a need that closes a cycle.
            needs = [f"n{random.randrange(size if random.random() < 0.1 else max(i, 1))}" for _ in range(random.choice([0, 1, 1, 1, 2, 3]))]
            calls.append((c, f"n{i}", [n for n in needs if n != f"n{i}"] + ["unknown"] * (i % 2)))
    calls += [(99, "own", ["own"]), (99, "behind", ["own"]), (99, "both", ["own", "free"]), (99, "free", [])]
    frame = spark.createDataFrame(calls, "conv_id long, id string, after array<string>")
    found = chat.depths(frame).collect()
    assert {(r.conv_id, r.id): r.depth for r in found} == brute_depths(calls)


def test_native_queries_have_no_python(spark, folder):
    for name in ("op1_url_filters", "op4_pii", "op7_chat", "op8_syncmers"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    found = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in docs.collect())
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").join(found, "doc_id", "left_semi")
    assert good.count() <= 1
