"""Operators against brute force, on rows with nulls, repeats, empty and odd texts, extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.llm import bpe, chat, crf_quality, embedding_dedup, line_dedup, mixing, ngram_join, quality_rules, sharding, warc
from graphwright.llm.common import components, extend_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, part int, h1 long, pos int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "ring", "stone", "É", "a", "zwölf", "###", "moon", "river", "x|y", "!!"]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), f"s{rng.choice([0, 0, 0, 1, 2, 3])}"))
    base = rows[3][1] + " " + " ".join(f"w{k}" for k in range(200))
    rows += [(100 + k, base + f" tail{k}", "s1") for k in range(8)] + [(120 + k, base, "s0") for k in range(5)]
    rows += [(200, None, "s0"), (201, "", None), (202, " \t\n ", "s2"), (203, "one", None), (None, base, None), (None, None, None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (204, "  Shared LINE text of ten\nshort", "s0"), (205, "shared line text of ten  \nshort\n\n", "s0"), (206, "moon " * 30_000, "s3")]
    return spark.createDataFrame([(i, t, None, s, 0, 7, "k", 1, 2, 3) for i, t, s in rows], DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(spark):
    df, rows = documents(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and not mixing.mix(empty(spark)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full, budget = {}, set(), sum(sizes.values()) * 1.5
    while True:  # reshare the excess until nothing is above
        rest, w = budget - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, mixing.mix(df, rows_per_range=5).collect())) == sorted(map(str, got))
    assert mixing.emit(df, mixing.mix(df)).columns == df.columns


def test_mixing_emits_the_copies_of_repeated_rows(spark):
    rows = [(7, "one two three", "a")] * 5 + [(k, "four five six", "a") for k in range(20, 22)] + [(7, "other two three", "a")] * 2 + [(None, f"x y {k}", "b") for k in range(9)] + [(30, None, "b"), (31, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for percent in (50, 90, 100, 130, 150, 190):
        taken = mixing.mix(df, percent).collect()
        due, got = Counter(), Counter()
        for r in taken:
            due[r["doc_id"], r["source"], r["size"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
        out = mixing.emit(df, mixing.mix(df, percent)).collect()
        for r in out:
            got[r["doc_id"], r["source"], len(r["text"].split())] += 1
        assert got == +due, percent
        for source in "ab":
            target = next(r["target"] for r in taken if r["source"] == source)
            assert abs(sum(len(r["text"].split()) for r in out if r["source"] == source) - target) <= 3
        each = Counter(r["text"] for r in out if r["source"] == "b")
        assert max(each.values()) - min([each[f"x y {k}"] for k in range(9)]) <= 1


def test_line_dedup(spark):
    df, rows = documents(spark)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    last = 10**18
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if i is None else i)
    expected = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in holders or min(holders[key(x)]) == (last if i is None else i)]
        expected.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    for batches, fanout in ((1, 3), (4, 2), (7, 2)):
        got = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert set(df.columns) <= set(got.columns)
    assert not line_dedup.dedup_lines(empty(spark)).collect()


def test_warc(spark, tmp_path):
    odd = "a\r\nb\r\n\r\nWARC/1.1\r\n5\r\n\r\n\n\r"
    rows = [(1, "http://a/ b", odd), (2, None, odd), (3, "u", None), (4, "u", ""), (5, "u", "é" * 700_000 + "\r\n"), (6, "u", "é" * 700_000 + "\r\n"), (None, "u", odd), (None, "n", "only"), (7, "u", "x"), (7, "u", "x"), (8, "u", "\r"), (9, "u", "\r\r\n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_warc(df, f"file://{tmp_path}/w")
    table = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        raw, win = (h or "").encode(), best[h or ""]
        revisit = (-1 if i is None else i) != win
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", win if revisit else None))
    got = [(r["page_id"], r["running_bytes"], r["running_digest"], r["record_type"], r["refers_to"]) for r in table if r["is_last"]]
    assert sorted(got, key=str) == sorted(expected, key=str)
    data = b"".join(bytes(r["data"]) for r in sorted(table, key=lambda r: r["chunk_no"]) if r["page_id"] == 6)
    assert data == ("é" * 700_000 + "\r\n").encode()
    assert max(r["chunk_bytes"] for r in table) <= 1 << 20
    warc.write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert not warc.read_warc(spark, f"file://{tmp_path}/none").collect()


def test_warc_writer_gets_chunks(spark):
    long = "é😀\r\n" * (warc.CHUNK // 4 * 3) + "x"
    df = spark.createDataFrame([(1, "u", long), (2, "u", ""), (3, "u", "ab")], "page_id long, url string, html string")
    rows = warc.chunk_rows(warc.plan_records(df)).collect()
    for k, html in ((1, long), (2, ""), (3, "ab")):
        mine = [r for r in rows if r["page_id"] == k]
        assert [r["chunk_no"] for r in mine] == (list(range(len(mine))) if html else [None])
        assert "".join(r["chunk"] or "" for r in mine) == html and all(len(r["chunk"] or "") <= warc.CHUNK for r in mine)
        sizes = [len((r["chunk"] or "").encode()) for r in mine if r["chunk"]]
        assert {r["body"] for r in mine} == {sum(n + len(f"{n:x}") + 4 for n in sizes)} and {r["n_chunks"] for r in mine} == {len(sizes)}


def test_warc_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r["page_id"]: r["revisit"] for r in warc.plan_records(df, 5).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_chat(spark):
    trap = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| \\n <|"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", trap), (1, 1, "assistant", trap), (2, 0, "system", None), (2, None, None, "x\ny"), (2, 2, "assi\\n\nst<|im_end|>", ""), (None, 0, "assistant", "é😀")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(chat.turn_rows(df)).select("conv_id", "formatted", chat.read_chat().alias("back"), chat.loss_text().alias("loss"))
    for r in out.collect():
        mine = sorted([(-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["back"]] == [(b, c) for _, b, c in mine]
        assert r["loss"] == "".join(c for _, b, c in mine if b == "assistant")
        assert r["formatted"].count("<|im_end|>") == len(mine)
    assert not chat.format_chat(chat.turn_rows(df.limit(0))).collect()


def test_chat_layouts(spark):
    rows = [
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "from_value", [("user", "a"), ("assistant", "b")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', "instruction_input", [("user", "i\nx"), ("assistant", "o")]),
        ('{"output": "o", "instruction": "i"}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        ('{"prompt": "p", "completion": "c"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ('{"question": "q", "answer": null}', "question_answer", [("user", "q"), ("assistant", None)]),
        ('{"other": 1}', None, None), ("not json", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, record string")
    for r in chat.canonical_turns(df).collect():
        _, layout, turns = rows[r["k"]]
        assert r["layout"] == layout
        assert (None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) == turns


def test_chat_layouts_with_further_keys(spark):
    rows = [
        ('{"id": "7", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "from_value", [("user", "a"), ("assistant", "b")]),
        ('{"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "x y": {"z>": [[1.5]]}, "tags": []}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"prompt": "p", "messages": [{"role": "user", "content": "a"}]}', "messages", [("user", "a")]),
        ('{"instruction": "i", "input": "", "output": "o", "meta": {"score": 1}}', "instruction_input", [("user", "i"), ("assistant", "o")]),
        ('{"meta": {"prompt": "p", "response": "r"}}', None, None), ('{"messages[].role": "user", "messages[].content": "a"}', None, None),
        ('{"messages": [{"role": "user"}]}', None, None), ('{"messages": []}', None, None), ('["prompt", "response"]', None, None),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, record string")
    got = chat.canonical_turns(df).collect()
    assert len(got) == len(rows) and len({r["fingerprint"] for r in got}) == len(rows)
    for r in got:
        _, layout, turns = rows[r["k"]]
        assert r["layout"] == layout, r["record"]
        assert (None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) == turns
    nested = spark.sql("""select '{"a": {"b": [{"c": 1, "d": [2]}, {"e": null}]}, "f": 1.5, "g.h": {"i": "x"}}' as record""")
    assert nested.select(chat.paths(F.try_parse_json("record"))).first()[0] == ["`g.h`.i", "a.b[].c", "a.b[].d[]", "a.b[].e", "f"]


def test_chat_query_maps_rows_by_fingerprint(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0, "user", "a" * 1000, 5), (1, 1, "assistant", "b", 6), (2, None, None, None, None)], "conv_id long, turn long, role string, text string, other int").write.parquet(f"{tmp_path}/conversations.parquet")
    table = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.turn_rows(table).collect()}
    assert {r["layout"] for r in got.values()} == {"turn_rows"}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a" * 1000), ("assistant", "b")] and [tuple(t) for t in got[2]["turns"]] == [("", "")]
    assert {r["conv_id"]: r["n_turns"] for r in chat.query(spark, str(tmp_path)).collect()} == {-1: 2, 1: 2, 2: 1}
    # with no known fingerprint the query maps nothing, and drops nothing
    monkeypatch.setattr(chat, "ROW_LAYOUTS", {"turn_rows": (("conv_id", "prompt"), chat.ROW_LAYOUTS["turn_rows"][1])})
    assert {r["conv_id"]: r["turns_sha256"] for r in chat.query(spark, str(tmp_path)).collect()} == {-1: None, 1: None, 2: None}


def test_sharding(spark):
    df, rows = documents(spark)
    got = sharding.shard(df, 4).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(4):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
        assert abs(sum(r["size"] for r in got if r["shard"] == s) - total / 4) <= longest
    assert [r["place"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == list(range(len(got)))
    assert not sharding.shard(empty(spark)).collect()


def test_sharding_sql(spark, tmp_path):
    import duckdb

    df, rows = documents(spark)
    df.where("length(text) < 5000 or text is null").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    expected = sorted(db.execute(f"select {', '.join(names)} from ({sharding.SQL})").fetchall(), key=str)
    assert len(expected) == len(rows) - 1
    assert sorted((tuple(r[n] for n in names) for r in sharding.query(spark, str(tmp_path)).collect()), key=str) == expected


def test_quality_rules(spark):
    df, rows = documents(spark)
    got = quality_rules.judge(df).select("q_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    expected = []
    for i, t, _ in rows:
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        expected.append((i, len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(hit), failed))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(expected, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert not quality_rules.judge(empty(spark)).collect()


@pytest.mark.parametrize("most", [100_000, 0])
def test_host_rates_reject_a_bad_host(spark, monkeypatch, most):
    """Twenty hosts fail at 10 to 25 %, one of 80 documents at 60 %, one of three at 67 %."""
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", most)
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(100 * h + k, "short" if k % 100 < 10 + h % 4 * 5 else good, f"h{h}") for h in range(20) for k in range(100)]
    rows += [(5000 + k, "short" if k % 5 < 3 else good, "bad") for k in range(80)] + [(6000, "a", "few"), (6001, "b", "few"), (6002, good, "few"), (6003, good, None)]
    judged = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["host"] for r in quality_rules.host_rates(judged).where("rejected").collect()} == {"bad"}
    for r in judged.select("q_row.doc_id", "q_row.source", "base_failed", "kept").collect():
        assert r["kept"] == (not r["base_failed"] and r["source"] != "bad")


def brute_components(rows, words, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(up)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 128), (5, 80, 3)])
def test_ngram_join(spark, words, percent, block):
    df, rows = documents(spark)
    sets, comp = brute_components(rows, words, percent)
    got = ngram_join.jaccard_components(df, words, percent, block=block).collect()
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=str) == sorted(((i, len(s)) for i in sets for s in sets[i]), key=str)
    assert all(r["component_id"] == (None if r["doc_id"] is None else comp[r["doc_id"]]) for r in got)
    assert not ngram_join.jaccard_components(empty(spark)).collect()


def test_tree_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for _ in range(30):
        n = int(rng.integers(2, 300))
        sets = []
        for _ in range(25):
            s = np.unique(np.concatenate([base[:n][rng.random(n) > rng.choice([0, 0.03, 0.1, 0.4])], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
            sets.append(s if len(s) else base[:1])
        rows = [(k, k, len(s), ngram_join.bitmap(s, ngram_join.width(len(s))), s) for k, s in enumerate(sets)]
        true = {(a, b) for a in range(25) for b in range(a + 1, 25) if ngram_join.links(sets[a], sets[b])}
        assert {k for p in true for k in p} <= {k for k, _ in ngram_join.tree_survivors([r[:4] for r in rows])}
        found = [tuple(sorted(p)) for p in ngram_join.tree_links(rows, check=lambda x, y: ngram_join.links(x[4], y[4]))]
        assert set(found) <= true and len(found) < len(rows)
        label = {k: k for k in range(25)}
        for a, b in found:
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
        assert all(label[a] == label[b] for a, b in true)


def near_group(n=60, words=110, seed=8):
    """A text and copies of it that link with it but hardly with each other."""
    rng, out = random.Random(seed), []
    base = [f"v{k}" for k in range(words)]
    for k in range(n):
        copy = list(base)
        copy[rng.randrange(4, words - 4)] = f"x{k}"
        copy[rng.randrange(4, words - 4)] = f"y{k}"
        out.append((1000 + k, " ".join(copy), "s"))
    return [*out, (5000, " ".join(base), "s")]


def test_ngram_join_on_copies_below_the_threshold(spark, monkeypatch):
    rows = near_group()
    _, comp = brute_components(rows, 4, 85)
    made, plain = [], ngram_join.save
    monkeypatch.setattr(ngram_join, "save", lambda df, name: (made.append((name, (out := plain(df, name)).count())), out)[1])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = ngram_join.jaccard_components(df, block=8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp and len(set(comp.values())) < len(rows) // 2
    assert dict(made)["links"] < len(rows)


def test_ngram_join_takes_rows_of_one_id_as_one_document(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a, 0), (3, a, 0), (3, b, 0), (4, b + " tail", 0), (4, "", 0), (7, None, 0), (7, "", 0), (9, "", 0), (9, a + " x", 0)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (3, 1), (4, 1), (7, 7), (9, 1)}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    rows = []
    for k in range(150):
        v = centers[rng.integers(0, 6)] + rng.normal(size=8) * rng.choice([0, 0.02, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] + [1.0] * 7, 0), (203, [None] + [1.0] * 7, 0), (204, rows[0][1], None), (205, rows[0][1], rows[0][2]), (205, rows[0][1], rows[0][2]), (None, rows[0][1], 0), (206, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep long")
    ok = [i is not None and l is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) for i, v, l in rows]
    n, up = Counter(), {i: i for i, *_ in rows if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, v, l) in enumerate(rows):
        for b, (j, w, m) in enumerate(rows):
            if a != b and ok[a] and ok[b] and l == m and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                n[a] += 1
                p, q = sorted((find(i), find(j)))
                up[q] = p
    expected = [(i, n[a], None if i is None else find(i)) for a, (i, *_) in enumerate(rows)]
    for block in (1024, 16):
        got = embedding_dedup.near_duplicates(df, block=block, pivots=4).collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert not embedding_dedup.near_duplicates(df.limit(0)).collect()


def test_embeddings_of_one_id_and_sql(spark, tmp_path):
    import duckdb

    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0), (5, [1.0, 0.02], 0), (5, [0.01, 1.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 2, 1), (3, 1, 1), (5, 1, 1), (5, 2, 1)]
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 16))
    rows = [(k, [float(np.float32(x)) for x in centers[k % 5] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])], k % 2) for k in range(80)]
    rows += [(100, None, 0), (101, [float("nan")] * 16, 0), (102, [None] * 16, 0), (103, [0.0] * 16, 1), (104, rows[0][1], None), (105, [float("inf")] + [1.0] * 15, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    names = ["vec_id", "n_links", "component_id", "kept"]
    expected = sorted(db.execute(f"select {', '.join(names)} from ({embedding_dedup.SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in embedding_dedup.query(spark, str(tmp_path)).collect()) == expected
    assert sum(r[1] for r in expected) > 100


def test_cover_trees_save_distances():
    """On clustered vectors the trees are built and descended with fewer distances than pairs."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 32))
    for spread in (0.0, 0.01, 0.05):
        raw = centers[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 32)) * spread
        x, y = raw[:800], raw[800:]
        count, ones = embedding_dedup.Distances(), lambda v: np.ones(len(v), np.int64)
        a, b = (embedding_dedup.CoverTree(embedding_dedup._unit(v), embedding_dedup.chord(0.93) / 4, count) for v in (x, y))
        for t, v in ((a, x), (b, y)):
            assert sorted(t.order) == list(range(len(v)))
            for centers_, starts, ends, radius, _, _ in t.levels:
                assert starts[0] == 0 and ends[-1] == len(v) and (starts[1:] == ends[:-1]).all()
                for c, s, e, r in zip(centers_, starts, ends, radius, strict=True):
                    assert c in t.order[s:e] and np.linalg.norm(embedding_dedup._unit(v)[t.order[s:e]] - embedding_dedup._unit(v)[c], axis=1).max() <= r + 1e-6
        nx, ny, _ = embedding_dedup.dual(a, x, ones(x), b, y, ones(y), False, 0.93, count)
        mx, my, _ = embedding_dedup.dual(a, x, ones(x), a, x, ones(x), True, 0.93, count)
        cross, own = embedding_dedup._unit(x) @ embedding_dedup._unit(y).T >= 0.93, embedding_dedup._unit(x) @ embedding_dedup._unit(x).T >= 0.93
        assert (nx == cross.sum(1)).all() and (ny == cross.sum(0)).all() and (mx + my == own.sum(1) - 1).all()
        assert count.n < (800 * 400 + 800 * 799 // 2) // 4, (spread, count.n)


def test_bpe(spark):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc AB\n\t\x1c\x85éß12!'s漢😀|<") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    texts += ["a" * 9000, "ab" * 4000, "".join(rng.choice("etaoin") for _ in range(9000)), "<|endoftext|>", "", None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.round_trip(df, path, p.PATTERN).collect():
        text = texts[r["key"]] or ""
        assert r["ids"] == own.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    back = bpe.decode(bpe.encode(df, path, p.PATTERN), path, p.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (texts[r["key"]] or "") for r in back.collect())
    assert not bpe.digests(df.limit(0)).collect()


def test_bpe_merges_wait_for_lower_ranks():
    """A vocabulary in which a merge brings up a lower rank, against plain rescanning."""
    rng = random.Random(6)
    for _ in range(40):
        words = {bytes([b]): 1000 + b for b in range(256)}
        many = sorted({bytes(rng.choice(b"abc\xc3\xff") for _ in range(rng.randint(2, 4))) for _ in range(25)})
        rng.shuffle(many)
        ranks = words | {w: r for r, w in enumerate(many)}
        codec = bpe.Codec(ranks, r"\S+|\s+")
        pieces = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 14))).encode() for _ in range(30)]
        for piece, ids in zip(pieces, codec.merge(pieces), strict=True):
            parts = [bytes([b]) for b in piece]
            while at := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None):
                parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]
            assert np.frombuffer(ids, np.int32).tolist() == [ranks[x] for x in parts]


def test_bpe_stretches_and_memo(monkeypatch):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(4)
    monkeypatch.setattr(bpe, "STRETCH", 50)
    monkeypatch.setattr(bpe, "GATHER", 120)
    monkeypatch.setattr(bpe, "MEMO", 40)
    codec = bpe.Codec(bpe.load_ranks(path), p.PATTERN)
    for _ in range(60):
        text = "".join(rng.choice(["the", " river", "  ", "\n", "'s", "'sand", " É", "12", " 漢字", "!?", " q" * 40, "x" * 50]) for _ in range(200))
        assert [x.tolist() for x in codec.encode([text, "", text[:70]])] == [own.encode_ordinary(x) for x in (text, "", text[:70])]
        assert len(codec.memo) <= 240 and all(len(k) <= bpe.MEMO_CHARS for k in codec.memo)


def test_crf(spark):
    good = [f"The river moves on and the stone number {k} stays. It is late." for k in range(40)]
    bad = [f"THE!! RIVER!! {k} ### $$$ BUY!!\n### $$$" for k in range(40)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*good, *bad, None, ""])], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in crf_quality.score(docs, labels).collect()}
    assert len(got) == 82 and all(0 <= s <= 1 for s in got.values())
    assert all(got[k] > 0.7 for k in range(40)) and all(got[k] < 0.7 for k in range(40, 80))
    assert {r["score"] for r in crf_quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert not crf_quality.score(docs.limit(0), labels).collect()


def test_crf_trains_on_all_lines(spark):
    good = ["The river moves on and the stone stays. It is late."] * 500
    long = [(k, "\n".join(good[: 450 + k] + ["### $$$ BUY!! BUY!!"] * (300 if k >= 8 else 0)), k < 8) for k in range(16)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in long], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(q)) for k, _, q in long], "doc_id long, quality int")
    kept = [(t, int(q)) for k, t, q in long if zlib.crc32(str(k).encode()) % 4 != 2]
    parts = sorted(((q, crf_quality.line_features(t)[0].astype(np.float32).tobytes()) for t, q in kept), key=lambda r: r)
    w, chain = crf_quality.train([np.frombuffer(f, np.float32).reshape(-1, crf_quality.N_FEATURES).astype(np.float64) for _, f in parts], [q for q, _ in parts])
    got = crf_quality.fit(docs, labels)
    assert len({q for _, q in kept}) == 2 and np.allclose(got[0], w) and np.allclose(got[1], chain)
    bad = crf_quality.scores(["\n".join(["### $$$ BUY!! BUY!!"] * 20)], *got)[0]
    assert bad < 0.3 < 0.5 < crf_quality.scores(["\n".join(good[:20])], *got)[0]


def test_crf_tells_lines_of_a_text_apart():
    """Bad documents hold ordinary lines too; only documents are labelled."""
    rng = random.Random(7)
    good = lambda n: [f"The {rng.choice(['river', 'stone', 'moon'])} moves on and the {rng.choice(['night', 'ring'])} stays. It is late." for _ in range(n)]
    bad = lambda n: [f"### $$$ BUY!! {rng.choice(['NOW', 'HERE'])} ***" for _ in range(n)]
    texts, labels = [], []
    for _ in range(60):
        texts += ["\n".join(good(rng.randint(3, 9))), "\n".join(good(rng.randint(1, 4)) + bad(rng.randint(4, 9)))]
        labels += [1, 0]
    w, chain = crf_quality.train([crf_quality.line_features(t)[0] for t in texts], labels)
    f, _ = crf_quality.line_features("\n".join(good(6) + bad(6) + good(6)))
    p = crf_quality.marginals((f @ w)[None], np.array([18]), chain)[0][0]
    assert p[:5].min() > 0.5 > p[7:11].max() and p[13:].min() > 0.5 and p[:5].mean() - p[7:11].mean() > 0.5


def test_crf_held_out_quality():
    import os

    import duckdb

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    rows = duckdb.sql(f"select l.doc_id, l.quality, d.text from '{d}/labels.parquet' l join '{d}/documents.parquet' d on l.doc_id = d.doc_id where l.quality in (0, 1) order by 1").fetchall()
    out = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    kept = [(crf_quality.line_features(t)[0], q) for (_, q, t), o in zip(rows, out, strict=True) if not o]
    w, chain = crf_quality.train([f for f, _ in kept], [q for _, q in kept])
    told = [(s, q) for s, q in zip(crf_quality.scores([t for (_, _, t), o in zip(rows, out, strict=True) if o], w, chain), [q for (_, q, _), o in zip(rows, out, strict=True) if o], strict=True)]
    pairs = [(a, b) for a, p in told for b, q in told if p == 1 and q == 0]
    assert len(pairs) > 100 and sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) > 0.98
    assert sum((s >= 0.7) == (q == 1) for s, q in told) / len(told) > 0.95


def test_crf_marginals_are_exact():
    rng = np.random.default_rng(0)
    emit, size, chain = rng.normal(size=(3, 4)), np.array([4, 2, 1]), rng.normal(size=(2, 2))
    p, pairs = crf_quality.marginals(emit, size, chain)
    for d in range(3):
        total, good, both = 0.0, np.zeros(4), np.zeros((2, 2))
        for code in range(2 ** size[d]):
            y = [code >> t & 1 for t in range(size[d])]
            w = np.exp(sum(emit[d, t] * y[t] for t in range(size[d])) + sum(chain[y[t], y[t + 1]] for t in range(size[d] - 1)))
            total += w
            good[: size[d]] += w * np.array(y)
            for t in range(size[d] - 1):
                both[y[t], y[t + 1]] += w
        assert np.allclose(p[d, : size[d]], good[: size[d]] / total) and np.allclose(pairs[d], both / total)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 8), (3, 5), (None, 1), (20, 21), (21, 22), (22, 23), (23, 19)], "a long, b long")
    assert {r["id"]: r["component_id"] for r in components(edges).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 19: 19, 20: 19, 21: 19, 22: 19, 23: 19}
    assert not components(edges.limit(0)).collect()
    more = spark.createDataFrame([(23, 9), (5, 4), (30, 31), (40, 30), (31, 31)], "a long, b long")
    whole = {(r["id"], r["component_id"]) for r in components(edges.unionAll(more)).collect()}
    got = extend_components(components(edges), more).collect()
    assert {(r["id"], r["component_id"]) for r in got} == whole and len(got) == len(whole)
    assert {(r["id"], r["component_id"]) for r in extend_components(components(edges.limit(0)), edges).collect()} == {(r["id"], r["component_id"]) for r in components(edges).collect()}


def test_pipeline_stages(spark):
    import corpus_pipeline

    df, rows = documents(spark)
    clean = [(300 + k, " ".join(f"w{(k * 37 + j * j) % 997}" for j in range(90)), "s1") for k in range(12)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows + clean], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "byte_bpe":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns
        got = out.collect()
        if name == "quality_rules":
            assert {300 + k for k in range(12)} <= {r["doc_id"] for r in got}
            assert all(len(WORD.findall(r["text"] or "")) >= 50 for r in got)
        if name == "line_dedup":
            assert len(got) == docs.count() and all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "ngram_jaccard":
            _, comp = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
            assert sorted({r["doc_id"] for r in got if r["doc_id"] is not None}) == sorted(i for i, c in comp.items() if i == c)
        docs = spark.createDataFrame(got, docs.schema)


def test_pipeline_stages_chain_lazily_and_by_value(spark):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    words = lambda seed, n: " ".join(f"w{(seed * 37 + j * j) % 997}" for j in range(n))
    rows = [(k, words(k, 80 + k) + "\nshared footer line", f"s{k % 3}") for k in range(12)] + [(50, "short", "s0"), (51, None, "s1"), (3, words(3, 83) + "\nshared footer line", "s0")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, docs, "")
    cut = corpus_pipeline.lines(spark, kept, "")  # the stage before is not written yet
    expected = sorted((i, t if i == 0 else t.replace("\nshared footer line", "")) for i, t, _ in rows if i < 50)
    assert sorted((r["doc_id"], r["text"]) for r in cut.collect()) == expected
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((i, t) for i, t, _ in rows if i < 50)
    mixed = corpus_pipeline.mix(spark, docs.where("doc_id < 50"), "")
    size = lambda t: len(WORD.findall(t or ""))
    total, weights = sum(size(t) for i, t, _ in rows if i < 50), {"s0": 3, "s1": 1, "s2": 2}
    own = {s: sum(size(t) for i, t, x in rows if x == s and i < 50) for s in weights}
    got = Counter()
    for r in mixed.collect():
        got[r["source"]] += size(r["text"])
    assert abs(got["s0"] - 2 * own["s0"]) <= 100 or got["s0"] < 2 * own["s0"]
    assert abs(sum(got.values()) - 1.5 * total) <= 300
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in corpus_pipeline.tokens(spark, cut, "").collect():
        text = next(t for i, t in expected if i == r["doc_id"])
        assert r["ids"] == encoding.encode_ordinary(text) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_keeps_one_row_of_repeated_documents(spark):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(80))
    rows = [(5, text, "s2"), (5, text, "s1"), (5, text, "s1"), (6, text, "s0"), (6, text + " x", "s0"), (7, "a b c", "s0"), (7, "a b c", "s0"), (7, "d e f g h i", None), (8, None, "s0"), (8, None, "s0"), (9, "", "s0"), (None, text, "s0"), (None, text, "s0")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    expected = [(5, text, "s1"), (7, "a b c", "s0"), (7, "d e f g h i", None), (8, None, "s0"), (9, "", "s0"), (None, text, "s0"), (None, text, "s0")]
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == Counter(expected)
