"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kmerloom.llm import decontaminate, html, licenses, mixing, ordermin, resemblance, simhash, substrings, tokens, toxicity, urls
from kmerloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, start long, `_hash` string, score double, fp long, part int, host string, kept string, labels string"


def prose(n, seed, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("aeioustrnl", k=2 + rnd.randrange(vocabulary) % 7)) for _ in range(n))


def table(spark, rows):
    """documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, "h", 0.5, 7, 3, "h", "k", "l") for i, t, s in rows], DOCS)


LONG = prose(20_000, 99)
BASE = [(5, None, "a"), (6, "", None), (7, "  \n\t", "b"), (8, "One two", "a"), (9, "One two", "a"), (9, "One two", "a"), (None, "no name here at all", "a"), (11, LONG, "b"), (12, prose(300, 1), "b"), (13, prose(300, 1) + " end", "b"), (14, prose(100, 2), "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, BASE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_simhash(docs, empty):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{brute(t):016x}") for i, t, _ in BASE)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[5] == of[6] == of[7] == 5 and of[8] == of[9] == 8 and of[13] == of[12] == 12
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_anchors_lose_no_link(spark, monkeypatch, hot):
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                v ^= 1 << b
            values.add(v)
    centre = rnd.getrandbits(64)  # more than SMALL at one anchor
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(62, 64) for b in range(31, 62)} | {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(40, 45) for b in range(50, 55) for c in (61, 62, 63)}
    fps = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    classes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    if hot:
        monkeypatch.setattr(simhash, "HOT_ANCHOR", 2)
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(classes)).collect()}
    groups = {}
    for x, one in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(one, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, small):
    from kmerloom.llm import components

    monkeypatch.setattr(components, "SMALL", small)
    links = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1040)] + [(7, 7), (2000, None)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[i] for i in range(1000, 1040)}) == 1 and len(set(got.values())) == 2


def brute_repeats(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc_id, _, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", ["none", "all", "collisions"])
def test_substrings(spark, monkeypatch, hot):
    if hot == "all":  # every minimiser
        monkeypatch.setattr(substrings, "HOT_WORDS", 0)
        monkeypatch.setattr(substrings, "HOT_SHARE", 1 << 40)
    if hot == "collisions":  # windows with one hash and different words
        source = open(substrings.__file__).read()
        assert "x = grams(words.hashes(), WINDOW)" in source
        exec(compile(source.replace("x = grams(words.hashes(), WINDOW)", "x = grams(words.hashes(), WINDOW) % _U(7)").replace("from .", "from kmerloom.llm."), "<collisions>", "exec"), scope := {})
        got = scope["digest"](scope["remove_repeats"](table(spark, BASE)))
        assert Counter(map(tuple, got.collect())) == brute_repeats(BASE)
        return
    passage = prose(60, 50)
    rows = [*BASE, (20, prose(40, 60) + "\n\n" + passage + "  " + prose(10, 61), "a"), (21, passage + " " + prose(50, 62), "a"), (22, "same " * 120, "a"), (23, prose(34, 63), "a"), (24, prose(34, 63), "a"), (25, prose(35, 64), "a"), (25, prose(35, 64), "a"), (None, prose(35, 64), "b"), (0, prose(36, 65), "b")]
    got = substrings.digest(substrings.remove_repeats(table(spark, rows)))
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows)


def test_substrings_of_nothing(empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_decontamination(spark, empty):
    item, short = prose(40, 70), "only four words here"
    words = item.split()
    broken = " ".join(words[:30] + ["other"] + words[31:])  # 31 of 36 shingles are left: over 0.8
    rows = [*BASE, (30, LONG + " " + item.upper().replace(" ", ", ") + " " + LONG, "a"), (31, broken, "a"), (32, " ".join(words[:25]), "a"), (33, item, "a"), (33, item, "a"), (34, short + " and more", "a")]
    items = spark.createDataFrame([(1, item), (1, item), (2, short), (3, None), (4, ""), (None, prose(50, 71))], "item_id long, text string")
    docs = table(spark, rows)
    got = sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.contaminations(docs, items).collect())
    assert got == [(30, 1, 36, 36), (31, 1, 31, 36), (33, 1, 36, 36), (33, 1, 36, 36)]
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert decontaminate.contaminations(empty, items).count() == 0 and decontaminate.contaminations(docs, items.where("item_id = 9")).count() == 0


def test_decontamination_of_more_rows_than_go_together(spark):
    item = "one two three four five six seven eight"
    docs = spark.range(2 * decontaminate.TOGETHER + 500).coalesce(1).selectExpr("id AS doc_id", f"CASE WHEN id % 997 = 3 THEN 'x {item} y' ELSE 'other words ' || id END AS text")
    left = {r["doc_id"] for r in decontaminate.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert left == {i for i in range(2 * decontaminate.TOGETHER + 500) if i % 997 != 3}


_MEMORY = """
import re
import pyarrow as pa
from kmerloom.llm.shared import lean
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
def run(batches):
    for batch in batches:
        parts = [bytes(1000) for _ in range(200_000)]
        kept.append(bytes(1000))  # stands above what is freed, which the allocator then keeps
        yield batch
        del parts
kept, batch = [], pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
before = held()
assert list(lean(run)([batch])) == [batch]
print(held() - before)
"""


def test_a_task_gives_freed_memory_back():
    said = subprocess.run([sys.executable, "-c", _MEMORY], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(said.stdout) < 100


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    items = [(i, prose(20 + i, 700 + i)) for i in range(8)]
    docs = table(spark, [(i, prose(50, i) + " " + t, "a") for i, t in items])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(i, i) for i in range(8)]


def test_urls(spark):
    rows = [(1, "https://WWW.Example.COM/en/x?q=/es/"), (2, "http://a.example.com/en/"), (3, "http://example.net/es/1"), (4, "ftp://x.org/xxx"), (5, "http://x.org/free-poker"), (6, "http://x.org/free"), (7, "http://x.org/freepoker"), (8, None), (9, "no scheme"), (10, "http://example.com"), (11, "http://notexample.com/en/"), (12, ""), (13, "http://h#a/en/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_verdicts(spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, html string")).collect()}
    assert got == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("example.net", "/es/1", "net/es/", "block"), 4: ("x.org", "/xxx", None, "block"),
        5: ("x.org", "/free-poker", None, "block"), 6: ("x.org", "/free", None, "allow"), 7: ("x.org", "/freepoker", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("example.com", "", None, "allow"),
        11: ("notexample.com", "/en/", "com/", "allow"), 12: ("", "", None, "allow"), 13: ("h", "", None, "allow"),
    }


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><p>menu</nav><div class='ad box'>buy</div><article><h1>Head &amp; more</h1><p>one <b>t</b>wo<p class=share>share<p>three\n four<br>five<script>var a='</p>'</script><div class='comments'>c</div></article><aside>side</aside><footer>foot</footer>"
    plain = "<body><div>Terms of use apply to all the things that you read here today</div><p>{}</p>"
    rows = [(1, "http://a.com/1", page), (2, "http://a.com/2", None), (3, None, ""), (4, "http://a.com/3", "text only &lt;x&gt; <b"), (5, "http://a.com/1", page)] + [(10 + i, f"http://b.com/{i}", plain.format(prose(30, 80 + i))) for i in range(5)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame([(*r, "t", 4) for r in rows], "page_id long, url string, html string, text string, shard int")).collect()}
    assert got[1]["text"] == got[5]["text"] == "Head & more one two three four five" and got[1]["n_chars"] == 35
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "text only <x>"
    assert all(got[10 + i]["text"] == prose(30, 80 + i) for i in range(5))
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = Tokenizer.from_file(str(path))
    odd = ["a  b", " a", "a ", "\n", "a\n\nb", "a\tb c", "<|endoftext|> x", "don't  I'll", "é  b,", "a\r\nb\r\n", "日本 語。", "a \nb", "...", "a... b.", "x\n.", "b,.! c", "\x1c a\x1cb", "a  b"]
    encoder = tokens.Encoder(str(path))
    for text in [*odd, LONG, prose(50, 1).replace(" ", ". "), ""]:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    got = tokens.token_files(docs, str(path), 2).orderBy("position").collect()
    start, want = 0, Counter()
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    for i, t, _ in BASE:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in BASE), key=lambda i: (i is not None, i or 0))
    assert tokens.token_files(empty, str(path), 2).count() == 0


def test_order_min_hash(spark, docs, empty):
    got = {(r["doc_id"], r["n_chars"]): r for r in ordermin.edit_fingerprints(docs).collect()}
    order = sorted(BASE, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t, _ in order]
    assert got[(11, len(LONG))]["edited_sha256"] == hashlib.sha256((LONG[: len(LONG) - len(LONG) // 4] + prose(300, 1)[: len(LONG) // 4]).encode()).hexdigest()
    assert sum(r["n_chars"] for r in got.values()) == sum(map(len, texts)) - 7  # one repeated row shares its key
    assert got[(8, 7)]["near_next"] == 1.0 and got[(12, len(texts[-3]))]["near_next"] > 0.9 and got[(5, 0)]["near_edited"] == 1.0
    last = got[(14, len(texts[-1]))]
    assert last["edited_sha256"] == hashlib.sha256((texts[-1][: len(texts[-1]) - len(texts[-1]) // 4] + texts[0][: len(texts[-1]) // 4]).encode()).hexdigest()
    assert ordermin.edit_fingerprints(empty).count() == 0


def test_sketch_feels_order():
    a = prose(400, 5)
    w = a.split()
    moved = " ".join(w[200:] + w[:200])
    s = ordermin.sketch
    assert ordermin.likeness(s(a), s(a)) == 1.0 and 0.2 < ordermin.likeness(s(a), s(moved)) < 0.95 and ordermin.likeness(s(a), s(prose(400, 6, 300))) < 0.2
    long = prose(1, 1) + "ab" * (1 << 19)
    assert (s(long + "c") == s(long + "c")).all()


def test_licenses(spark, empty):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "cc by cc-by! CC  BY x"), (3, None), (4, ""), (5, "GNU General Public License, version 3, all rights reserved"), (6, "nothing here"), (7, LONG + " All Rights Reserved"), (8, "under a permit licence"), (9, "Licensed under CC BY-NC 4.0."), (10, "released under the MIT License")]
    got = {r["doc_id"]: r for r in licenses.license_report(table(spark, [(i, t, "a") for i, t in rows])).collect()}
    pick = lambda i: (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"], got[i]["labels"])
    assert pick(1) == (8, 0, None, None, "", "apache-2.0")
    assert pick(2) == (7, 3, 0, 4, "cc-by", "cc-by")
    assert pick(3) == pick(4) == (0, 0, None, None, "", "") and pick(6) == (2, 0, None, None, "", "")
    assert pick(5) == (9, 2, 1, 6, "gpl,reserved", "gpl,gpl-3.0,reserved")
    assert pick(7)[:4] == (20_003, 1, 20_000, 20_000) and pick(8)[5] == "" and pick(9)[5] == "cc-by,cc-by-nc-4.0" and pick(10)[5] == "mit"
    assert got[1]["score"] == 0.95 and got[6]["score"] == 0.0
    assert 100 < len(licenses.rules()) and licenses.license_report(empty).count() == 0


def test_mixing(spark, empty):
    rows = [(i, "t", "big") for i in range(700)] + [(1000 + i, "t", "small") for i in range(90)] + [(2000, "t", None), (2000, "t", None), (None, "t", "small")]
    got = mixing.mixed(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    per_slot = Counter(r["_slot"] for r in got)
    assert max(per_slot.values()) <= mixing.BLOCK and len({(r["_slot"], r["_place"]) for r in got}) == len(rows)
    assert mixing.mixed(empty).count() == 0


def worst_lag(spark, weights):
    """How far any source is from its share at most, and the slots of a cycle."""
    rows = mixing.cycle(spark.createDataFrame(list(weights.items()), "key string, s long")).collect()
    q, total = rows[0]["q"], sum(weights.values())
    assert sorted(x for r in rows for x in r["slots"]) == list(range(q)) and len(rows) == len(weights)
    worst = 0.0
    for r in rows:
        slots, share = np.array(sorted(r["slots"])), weights[r["key"]] / total
        assert len(slots) == r["s"]
        j = np.arange(len(slots))
        worst = max(worst, np.abs(j + 1 - (slots + 1) * share).max(), np.abs(j - slots * share).max(), abs(len(slots) - q * share))
    return worst, q


def test_schedule_is_less_than_a_block_off(spark):
    assert worst_lag(spark, {"a": 500, "b": 333, "c": 100, "d": 66, "e": 1}) < (1, 1001)
    assert worst_lag(spark, {"a": 12, "b": 8, "c": 4})[1] == 6 and worst_lag(spark, {"a": 7})[0] == 0
    many = {"big": 400} | {f"s{i}": 4 for i in range(2000)}
    lag, q = worst_lag(spark, many)
    assert lag < 1 and q == 2100


def test_weights_beyond_a_cycle_are_rounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CYCLE", 50)
    monkeypatch.setattr(mixing, "FINE", 4)
    rows = {r["key"]: r for r in mixing.cycle(spark.createDataFrame([("a", 70_001), ("b", 30_011), ("c", 1)], "key string, s long")).collect()}
    assert {k: r["s"] for k, r in rows.items()} == {"a": 35, "b": 15, "c": 1} and sorted(x for r in rows.values() for x in r["slots"]) == list(range(51))


def test_mixing_of_hot_ids_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    rows = [(7, f"t{i % 3}", "a", i) for i in range(150)] + [(None, "n", "a", i) for i in range(60)] + [(i, "t", "ab"[i % 2], i) for i in range(100)] + [(1, None, None, 0)]
    docs = spark.createDataFrame([(*r, "k", 5, 6, 7, 8) for r in rows], "doc_id long, text string, source string, n int, `_key` string, s int, q int, slot int, `a.b` int")
    got = mixing.mixed(docs).collect()
    assert Counter((r["doc_id"], r["text"], r["source"], r["n"]) for r in got) == Counter(rows) and all((r["_key"], r["s"], r["q"], r["slot"], r["a.b"]) == ("k", 5, 6, 7, 8) for r in got)
    for source in ("a", "b", None):
        own = sorted((r["_block"], r["_place"]) for r in got if r["source"] == source)
        assert own == [divmod(i, mixing.BLOCK) for i in range(len(own))]
    assert len({r["_slot"] for r in got}) == len({(r["source"], r["_block"]) for r in got})
    monkeypatch.setattr(mixing, "SENT_SLOTS", 0)
    plain = docs.where("doc_id <> 7")
    joined = sorted(map(str, mixing.mixed(plain).collect()))
    monkeypatch.setattr(mixing, "SENT_SLOTS", 1 << 20)
    assert sorted(map(str, mixing.mixed(plain).collect())) == joined


def test_mixing_numbers_groups_alike(spark, monkeypatch):
    rows = [(i, "t", "ab"[i % 3 == 0]) for i in range(300)]
    want = {r["doc_id"]: (r["_block"], r["_place"]) for r in mixing.mixed(table(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "GROUP", 8)
    assert {r["doc_id"]: (r["_block"], r["_place"]) for r in mixing.mixed(table(spark, rows)).collect()} == want


def test_toxicity(spark, empty):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(120, 9000 + i).split()
        for _ in range(4 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["zkbadword", "qqinsult", "wwvile"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    docs = table(spark, [*rows, (None, None, "a"), (5000, "", "a"), (5001, LONG, "a"), (5001, LONG, "a")])
    df = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, df).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    assert toxicity.toxicity(empty, df).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, df.where("toxic = 1")).collect()} == {0.0}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = prose(40, 70)
    rows = [(i, prose(80, 300 + i), f"s{i % 3}") for i in range(60)] + [(100, prose(80, 300), "s0"), (101, prose(30, 1) + " " + item, "s1")]
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    table(spark, rows).select(*cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).orderBy("position").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60))
    placed = mixing.mixed(table(spark, rows[:60])).orderBy("_slot", "_place").select(F.col("doc_id")).collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in placed]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]


def test_hosts_are_sharded_alike_however_they_are_joined(spark, monkeypatch):
    shared = "one two three four five six seven eight nine ten"
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<div>{shared}</div><div>own words of page number {i} stand here</div>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html, "SHARD", 5)
    sent = sorted(map(tuple, html.extract(pages).collect()))
    monkeypatch.setattr(html, "HOT_SHARE", 2)
    joined = sorted(map(tuple, html.extract(pages).collect()))
    assert sent == joined and len(sent) == 60


def test_hot_classes_of_fingerprints(spark, monkeypatch):
    texts = ["the same words again and again"] * 9 + [f"other words {i * 7919} that {i * 104729} differ {i}" for i in range(6)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == plain and len(plain) == len(texts)


def test_shards_of_a_host_change_no_text(spark, monkeypatch):
    rnd = random.Random(8)
    passages = [prose(12, 500 + k) for k in range(12)]  # each on some pages only
    rows = [(i, "http://h.org/" + str(i), "".join(f"<div>{p}</div>" for p in rnd.sample(passages, 2)) + f"<p>{prose(20, 900 + i % 50)}</p>") for i in range(60)]
    pages = spark.createDataFrame([*rows, rows[0], (99, None, None)], "page_id long, url string, html string")
    whole = sorted(map(str, html.extract(pages).collect()))
    monkeypatch.setattr(html, "SHARD", 5)
    assert sorted(map(str, html.extract(pages).collect())) == whole
    assert all(sum(p in r for p in passages) == 0 for r in whole)


def test_runs_that_half_a_host_repeats_leave_main_elements(spark, monkeypatch):
    notice, passage = prose(12, 700), prose(12, 701)
    rows = [(i, f"http://h.org/{i}", f"<article><p>{notice}</p><p>{prose(20, 710 + i)}</p>" + (f"<p>{passage}</p>" if i < 5 else "") + "</article>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (2000, 6):
        monkeypatch.setattr(html, "SHARD", shard)
        got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
        assert got == {i: prose(20, 710 + i) + (" " + passage if i < 5 else "") for i in range(20)}


@pytest.mark.parametrize("wrapper", ["div class='page has-sidebar'", "div class='layout-with-sidebar'", "div id=no-comments", "div class=menu-open", "form action=x.aspx"])
def test_wrappers_keep_their_articles(wrapper):
    tag = wrapper.split()[0]
    for element in ("article", "main", "div"):
        page = f"<body><nav>menu</nav><{wrapper}><{element}><p>the text of it</p><div class=share>share</div></{element}><div class=sidebar><article>teaser</article></div></{tag}><div class='related-posts'>more</div></body>"
        assert html.main_texts([html.blocks(page)]) == ["the text of it"], (wrapper, element)
    comments = "<body><div>the text of it</div><div class=comments><article>a reply that is longer than all of the text</article></div><form>search</form></body>"
    assert html.main_texts([html.blocks(comments)]) == ["the text of it"]


def some_match(pattern, rnd):
    """A text that the pattern matches, by its syntax tree."""
    from re import _parser

    def made(tree):
        out = ""
        for kind, value in tree:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "MAX_REPEAT":
                low, high, inner = value
                out += "".join(made(inner) for _ in range(rnd.randint(low, min(high, low + 3))))
            elif name == "BRANCH":
                out += made(rnd.choice(value[1]))
            elif name == "SUBPATTERN":
                out += made(value[3])
            elif name == "IN":
                kind, value = value[0]
                out += chr(value) if str(kind) == "LITERAL" else "word" if str(kind) == "CATEGORY" else chr(rnd.randint(*value))
            else:
                raise ValueError(name)
        return out

    return made(_parser.parse(pattern))


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " " + " ".join(words) + " "
    found = []
    for label, _, priority, sure, pattern in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
            first = line[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), priority, label, sure))
    kept = [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and (o[2] > d[2] or (o[2] == d[2] and o[1] - o[0] > d[1] - d[0])) for o in found)]
    base = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return (
        len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({b[1] for b in base})),
        ",".join(sorted({b[1] for b in base} | {d[3] for d in kept})), max([d[4] for d in kept] + [licenses.BASE_SURE] * bool(base), default=0.0),
    )


def test_licenses_by_brute_force(spark):
    """Every rule's matches hold one of its keywords and are found; rules in each other and side by side, ties and repeats too."""
    rnd = random.Random(12)
    texts = ["See the Apache 2.0 file for details", "Code: 3-clause BSD", "Code: 3-clause BSD, we walked under trees", "released under the WTFPL version 2", "Creative Commons Zero 1.0 Universal", "CC0", "an accident of discovery, under trees", None, "", "mit der Zeit", "GPL GPL GPL", "\u0130sc ISC", "cc by " * 300]
    for label, keys, _, _, pattern in licenses.rules():
        for _ in range(4):
            text = some_match(pattern, rnd)
            assert re.fullmatch(pattern, text) and set(keys) & set(text.split()), (label, text)
        texts.append(text)
    texts += [" ".join(some_match(licenses.rules()[rnd.randrange(len(licenses.rules()))][4], rnd) + rnd.choice([", ", " and ", "\n"]) for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    texts += texts[:20]
    got = sorted(map(tuple, licenses.license_report(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()))
    assert got == [(i, *brute_licenses(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("text", "label"), [("SPDX-License-Identifier: MIT", "mit"), ("GPL-2.0-only", "gpl-2.0"), ("ISC", "isc"), ("Licensed under the GPLv3 license", "gpl-3.0"), ("MPL-2.0", "mpl-2.0"), ("LGPL-2.1", "lgpl-2.1"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa-4.0")])
def test_short_names_of_licenses(text, label):
    assert label in brute_licenses(text)[5].split(",")


def test_scans_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([("MIT License", 1, 2, 3, 4, 5, "k")], "text string, n_words long, _t int, base int, detections int, score int, `a.b` string")
    row = licenses.scans(docs).collect()[0]
    assert row["_t"] == 2 and row["a.b"] == "k" and row["n_words"] == 2 and row["labels"] == ["mit"] and row["score"] == 0.8



def test_one_of_each_group_of_like_texts(spark):
    rnd = random.Random(5)
    texts = []
    for k in range(12):  # each a chain of changes, some of few words
        words = prose(20 + 15 * k, 1000 + k).split()
        for _ in range(9):
            texts.append(" ".join(words))
            words[rnd.randrange(len(words))] = f"x{rnd.random()}"
    ids = [*range(len(texts) - 6), 3, 3, 9, None, None, None]  # not unique
    rows = [*zip(ids, texts, strict=True), (500, ""), (501, None), (502, "One two"), (503, "one  TWO"), (7, texts[7]), (None, texts[0])]
    got = resemblance.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]) and label[i] != label[j]:
                label = [label[j] if k == label[i] else k for k in label]
    want = Counter(min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if label[i] == k) for k in set(label))
    assert 12 < len(want) and Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == want


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = prose(150, 1).split()
    near = " ".join(words[:70] + ["changed"] + words[71:])
    rows = [(1, prose(60, 30), "a"), (1, prose(60, 31), "a"), (2, " ".join(words), "a"), (56, near, "a"), (None, near, "a")]
    got = pipeline.near_dedup(spark, table(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, t) for i, t, _ in rows[:3])


@pytest.mark.parametrize(
    "element",
    [
        '<div style="overflow:hidden">the valley</div>', '<p><a href="/hidden/valley">the valley</a></p>', '<p><a href="/p?id=menu">the valley</a></p>', '<p data-hidden="false">the valley</p>',
        '<p title=\'class="ad"\'>the valley</p>', '<h2 id="related-work">the valley</h2>', '<h2 id="social-history">the valley</h2>', '<h3 class="menu">the valley</h3>', '<p data-role="main" data-class="ad">the valley</p>',
    ],
)
def test_attributes_are_read_one_by_one(element):
    assert html.main_texts([html.blocks(f"<body><article><p>before</p>{element}<p>after</p></article></body>")]) == ["before the valley after"]


@pytest.mark.parametrize("element", ['<article class="ad">buy this</article>', "<p hidden>buy this</p>", "<div CLASS='Ad'>buy this</div>", "<p aria-hidden=TRUE>buy this</p>", "<div id=ad>buy this</div>", '<div role="Banner">buy this</div>'])
def test_adverts_and_what_is_hidden_go(element):
    assert html.main_texts([html.blocks(f"<body><article><p>before</p></article>{element}</body>")]) == ["before"]
    assert html.main_texts([html.blocks(f"<body><div><p>before</p></div>{element}</body>")]) == ["before"]


def test_suffix_array():
    rnd = random.Random(5)
    size = [rnd.randrange(0, 60) for _ in range(40)]
    token = np.array([rnd.randrange(3) for _ in range(sum(size))])
    end = np.repeat(np.cumsum(size), size)
    order, begins = html.suffix_array(token, end)
    runs = [tuple(token[i : i + html.RUN]) for i in order]
    assert sorted(order.tolist()) == [i for i in range(len(token)) if i + html.RUN <= end[i]]
    assert runs == sorted(runs) and begins.tolist() == [i for i in range(len(runs)) if i == 0 or runs[i] != runs[i - 1]]


def test_urls_of_every_kind(spark, monkeypatch):
    """Escapes, terms within words, long and repeated URLs, rules of equal length, an empty table."""
    rows = [
        ("http://a.org/?u=http%3A%2F%2Fporn.org", "block"), ("http://a.org/%70orn", "block"), ("http://a.org/adult-education", "allow"), ("http://adult-x.a.org/", "block"), ("http://a.org/pornographer", "allow"), ("http://a.org/sussex/hotel", "allow"),
        ("http://a.org/" + "x" * 200_000 + "/casino/win", "block"), ("http://a.org/casino/casino", "allow"), ("http://a.org/casino/bets", "block"), ("http://a.org/%zz%", "allow"), ("HTTP://A.ORG/XXX", "block"), ("http://a.org/casino/bets", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "x", 1, 2) for i, (u, _) in enumerate(rows)], "page_id long, url string, host string, n_soft int, verdict int")
    got = urls.url_verdicts(pages).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == [v for _, v in rows] and got[0]["host"] == "a.org"
    assert urls.url_verdicts(pages.where("page_id < 0")).count() == 0
    ties = [("block", "b.org", "/x"), ("allow", "b.org", "/y"), ("allow", "c.b.org", "/")]  # of equal length where both fit: none here
    got = urls.url_verdicts(spark.createDataFrame([(1, "http://b.org/x/1"), (2, "http://c.b.org/y"), (3, "http://c.b.org/x")], "page_id long, url string"), rules=ties).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("b.org/x", "block"), ("c.b.org/", "allow"), ("c.b.org/", "allow")]


def test_stages_take_rows_as_they_are(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, empty and very long texts, other columns, no documents."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, prose(60, 40 + i), "en", "ab"[i % 2], 3) for i in range(30)]
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (7, prose(70, 200), "en", "a", 1), (7, prose(70, 201), "en", "a", 1), (7, prose(70, 201), "en", "a", 1), (None, LONG, "en", "b", None), (None, LONG, "en", "b", None), (99, prose(20_000, 300), None, "b", 9)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, `_slot` long, score double, `_hash_of_text` string, node long"
    docs = spark.createDataFrame([(*r, 5, 0.5, "x", 4) for r in rows], columns)
    spark.createDataFrame([(1, prose(30, 900)), (2, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(30)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = docs.where("doc_id = -1")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == pipeline.COLUMNS and stage(spark, empty, str(tmp_path)).count() == 0, name
        got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
        all_rows = Counter((r[0], r[1], r[3]) for r in rows)
        assert not got - all_rows, name
        if name in ("decontamination", "mixing"):
            assert got == all_rows, name
        if name == "near_dedup":  # texts without words, the two equal ones of id 7 and the two long ones are groups
            assert sum(got.values()) == len(rows) - 3
    mixed = pipeline.mixing(spark, docs, str(tmp_path))
    mixed.write.parquet(str(tmp_path / "mixed.parquet"))
    held = spark.read.parquet(str(tmp_path / "mixed.parquet"))
    lists = [[tuple(r) for r in pipeline.tokens(spark, d, str(tmp_path)).orderBy("position").collect()] for d in (held, docs)]
    assert len(lists[0]) == len(rows) and [r[1] for r in lists[0]] == [r[0] for r in mixed.collect()]
    assert Counter(r[1:2] + r[3:] for r in lists[0]) == Counter(r[1:2] + r[3:] for r in lists[1])
    assert pipeline.tokens(spark, empty, str(tmp_path)).count() == 0


def test_order_minhash_by_plain_loops():
    """The same sketch from k-mers, numbers and places written out."""
    for text in ["", "a", "abcdefgh", "abcdefghi", prose(40, 3), "ab" * 100, prose(300, 4) + " \U0001F600 " + prose(20, 5), prose(30, 6) * 5]:
        points = [ord(c) for c in text]
        out = [0] * ordermin.BINS
        if points:
            k = min(ordermin.K, len(points))
            seen, bins = Counter(), {}
            for at in range(len(points) - k + 1):
                h = int(ordermin.grams(np.array(points[at : at + k], np.uint64), k)[0]) >> 20
                number = seen[h]
                seen[h] += 1
                mixed = int(ordermin.mix(np.array([(h * 0x9E3779B97F4A7C15 + number * 0xC2B2AE3D27D4EB4F + 1) % 2**64], np.uint64))[0]) >> 20
                bins.setdefault(mixed * ordermin.BINS >> 44, []).append((mixed, at))
            for b, held in bins.items():
                least = sorted(sorted(held)[: ordermin.L], key=lambda x: x[1])
                value = 0
                for j in range(ordermin.L):
                    value = int(ordermin.mix(np.array([(value * 0x9E3779B97F4A7C15 + (least[j][0] + 1 if j < len(least) else 0)) % 2**64], np.uint64))[0])
                out[b] = max(1, value >> 48)
        assert ordermin.sketch(text).tolist() == out, text[:20]
