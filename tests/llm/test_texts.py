"""MinHash, splitting, packing, mixing and sentences against brute force and exact round trips."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardlight.llm import minhash, mixing, packing, sentences, splitter, tokens

WORDS = ["index", "shard", "vector", "cache", "token", "replica", "flush", "merge", "query", "batch", "panel", "route", "node", "disk", "lock"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


# -- near duplicates ---------------------------------------------------------------------------------------------------
def brute_pairs(records, threshold=0.6):
    sets = {}
    for rid, t in records:
        if rid is not None and t is not None:
            n = minhash.normalise(t)
            if len(n) >= 200:
                sets.setdefault(rid, {n[i : i + 5] for i in range(len(n) - 4)})
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def records(seed=2):
    rng = random.Random(seed)
    rows = []
    for f in range(25):
        base = prose(rng, rng.randrange(30, 120)).split(" ")
        for v in range(rng.randrange(1, 6)):
            words = [w if rng.random() > 0.04 * v else rng.choice(WORDS) for w in base]
            rows.append((f"{'dc'[f % 2]}{f}-{v}", " ".join(words)))
    rows += [(f"dx{i}", "  Same   TEXT " * 30 + ("\n" if i % 2 else " ")) for i in range(6)]
    rows += [("dn", None), (None, "t" * 300), ("ds", "short"), ("de", ""), ("dl", prose(rng, 20_000)), ("du", "z" * 5000), ("dsp", " " * 400)]
    rows.append(rows[0])
    return rows


@pytest.mark.parametrize("opts", [minhash.MinHashOptions(), minhash.MinHashOptions(block_rows=2)])
def test_near_duplicates(spark, opts):
    rows = records()
    df = spark.createDataFrame([(r, t, None, "extra") for r, t in rows], "rid string, text string, arrived timestamp_ntz, code string").repartition(3)
    found = minhash.near_duplicates(df, opts)
    got = {(r[0], r[1]) for r in found.pairs().collect()}
    want = brute_pairs(rows)
    assert got <= want and len(got) / len(want) >= 0.98
    compact = {(r[0], r[1]) for r in found.pairs(bound=1).collect()}
    assert compact <= got
    classes = {r["rid"]: (r["class_id"], r["links"]) for r in found.classes().collect()}
    assert set(classes) == {x for p in got for x in p}
    assert len({classes[f"dx{i}"][0] for i in range(6)}) == 1 and classes["dx3"][1] == 5
    assert minhash.near_duplicates(df.limit(0)).pairs().count() == 0


def test_a_band_key_is_cut_by_its_size(spark):
    """A key with one per cent of the rows: cut as soon as these are more than a block, and seen in a sample of the table."""
    rng = np.random.default_rng(1)
    opts = minhash.MinHashOptions(block_rows=500, seen=100)
    keys = rng.integers(0, 2**63, (100_000, opts.bands)).astype(np.uint64)
    keys[:1000, 3] = 77
    df = spark.createDataFrame([(f"d{i}", k.tobytes()) for i, k in enumerate(keys)], "rid string, keys binary")
    hot = minhash.hot_bands(df, opts)
    assert set(hot) == {77} and 2 <= hot[77] <= 4
    assert minhash.hot_bands(df, minhash.MinHashOptions(block_rows=2000, seen=400)) == {}


def test_copies_that_disagree_count_as_the_first(spark):
    rng = random.Random(8)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [("d1", a, "2025-01-02"), ("d1", b, "2025-01-01"), ("d2", b + " more", "2025-01-01"), ("d3", a + " more", "2025-01-01")]
    df = spark.createDataFrame(rows, "rid string, text string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp_ntz"))
    assert {(r[0], r[1]) for r in minhash.near_duplicates(df).pairs().collect()} == {("d1", "d2")}


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_estimates(bits):
    rng = random.Random(bits)
    opts = minhash.MinHashOptions(minima=512, bits=bits, bands=4)
    errors = []
    for _ in range(20):
        a = prose(rng, 150).split(" ")
        b = [w if rng.random() > 0.15 else rng.choice(WORDS) for w in a]
        texts = [" ".join(a), " ".join(b)]
        s = minhash.signatures(minhash.minima(texts, opts), opts)
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in texts)
        errors.append(minhash.estimated(s[:1], s[1:], opts)[0] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


# -- splitting ---------------------------------------------------------------------------------------------------------
def check_pieces(text, pieces, opts):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    ln = lambda c: unicodedata.category(c)[0] in "LN"
    for (a, b), (c, _) in zip(pieces, pieces[1:], strict=False):
        assert c == b - opts.overlap
        if ln(text[b - 1]) and ln(text[b]):
            assert not any(x.isspace() or x in splitter.TERMINATORS for x in text[b - opts.reach : b])
    assert all(0 < b - a <= opts.limit for a, b in pieces)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n.。é　", min_size=61, max_size=900), st.integers(60, 400))
def test_ranges_are_stitched(text, range_chars):
    opts = splitter.SplitOptions(limit=60, overlap=7, reach=20, range_chars=range_chars)
    whole = splitter.walk(text, True, len(text), np.array([0]), opts)[2]
    check_pieces(text, whole, opts)
    at, got = 0, []
    for lo in range(0, len(text), range_chars):  # range by range, as the tasks do
        size = min(range_chars, len(text) - lo)
        stop = min(len(text), lo + size + opts.limit + 1)
        if at < 0 or at >= size:
            at = at - size if at >= 0 else at
            continue
        exit_, _, part = splitter.walk(text[lo:stop], stop == len(text), size, np.array([at]), opts)
        got += [(lo + a, lo + b) for a, b in part]
        at = int(exit_[0]) - size if exit_[0] >= 0 else -1
    assert got == whole


def test_split_tables_and_files(spark, tmp_path):
    rng = random.Random(5)
    texts = {1: prose(rng, 3000), 2: "x" * 4000, 3: "short", 4: None, 5: "", 6: "語。" * 900, 7: prose(rng, 90), 8: " " * 2000}
    df = spark.createDataFrame([(k, t, "e") for k, t in texts.items()], "doc_id long, text string, key string")
    for range_chars in (65_536, 1000):
        opts = splitter.SplitOptions(range_chars=range_chars)
        got = {}
        for r in splitter.split_documents(df, opts=opts).orderBy("key", "piece_no").collect():
            got.setdefault(int(r["key"]), []).append((r["piece_no"], r["start_idx"], r["end_idx"]))
        assert set(got) == {k for k, t in texts.items() if t and len(t) > 512}
        for k, p in got.items():
            assert [n for n, _, _ in p] == list(range(len(p)))
            check_pieces(texts[k], [(a, b) for _, a, b in p], opts)
    big = prose(rng, 2000) + " 語り手。é " * 500
    (tmp_path / "big.txt").write_text(big, encoding="utf-8")
    opts = splitter.SplitOptions()
    (tmp_path / "small.txt").write_text("one short file", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    paths = [str(tmp_path / f"{n}.txt") for n in ("big", "small", "empty")]
    want = splitter.walk(big, True, len(big), np.array([0]), opts)[2]
    for width in (64, 2, 3):  # runs of tables in one level, and in several
        rows = splitter.pieces(splitter.file_ranges(spark, paths, opts, range_bytes=4096), opts, width).orderBy("piece_no").collect()
        assert [(r["start_idx"], r["end_idx"]) for r in rows if r["key"] == paths[0]] == want
        assert [(r["piece_no"], r["start_idx"], r["end_idx"]) for r in rows if r["key"] == paths[1]] == [(0, 0, 14)]
        assert {r["key"] for r in rows} == set(paths[:2])


def test_faulty_chunks(spark):
    t = ("A sentence about the index. " * 60).strip()
    p = splitter.walk(t, True, len(t), np.array([0]), splitter.SplitOptions())[2]
    docs = spark.createDataFrame([(1, "d", t, None), (2, "d", "later text", "2025-01-02"), (3, "one", "tiny", None)], "doc_id long, ext_id string, text string, at string")
    docs = docs.selectExpr("doc_id", "ext_id", "text", "coalesce(CAST(at AS TIMESTAMP_NTZ), TIMESTAMP_NTZ'2025-01-01') AS received_at")
    good = [(f"g{i}", "d", t[a:b].strip(), a, b) for i, (a, b) in enumerate(p)]
    run = lambda rows: {r["chunk_id"]: r["reason"] for r in splitter.faulty_chunks(docs, spark.createDataFrame([(*r, None, 1) for r in rows], "chunk_id string, doc_id string, text string, start_idx long, end_idx long, created_at timestamp_ntz, range_no int"), block=600).collect()}
    assert run(good + good[:1]) == {}
    assert run([("x", "unknown", "q", 0, 1), ("y", "one", "tiny", 0, 4)]) == {}
    assert run([*good[:-1], ("bad", "d", "other", *p[-1])]) == {"bad": "other text"}
    assert run([("long", "d", t[:600].strip(), 0, 600)])["long"] == "too long"
    assert run([("cut", "d", t[:305].strip(), 0, 305), ("rest", "d", t[255:700].strip(), 255, 700)]) == {"cut": "cuts a word", "rest": "no end"}
    assert run([("n", "d", None, 0, 10), ("m", "one", "tiny", None, 4), ("o", "one", "tinyx", 0, 5)]).keys() == {"n", "m", "o"}
    assert run(good[1:])["g1"] == "no start"
    assert run([]) == {}


# -- packing -----------------------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=300), st.integers(1, 9))
def test_best_fit(sizes, open_containers):
    placed, free = packing.best_fit(sizes, 50, open_containers)
    used = np.bincount(placed, sizes, minlength=len(free)) if placed else np.zeros(0)
    assert len(placed) == len(sizes) and all(used + free == 50) and all(f >= 0 for f in free)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, n) for i, n in enumerate([0, 0, 100, 101, 250, 1000] + [rng.randrange(1, 100) for _ in range(3000)])] + [(7, 5)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), [("k", 100), ("k", 100), ("big", 1000), (None, 5), ("zero", 0)], packing.PackOptions(16, 200)).toPandas()
    for kind, capacity in (("k", 100), ("big", 1000)):
        p = packed[packed.container_kind == kind]
        assert p.tokens.sum() == sum(n for _, n in rows)
        boxes = p.groupby("container_id").agg(u=("tokens", "sum"), a=("unused", "min"), b=("unused", "max"))
        assert (boxes.u + boxes.a == capacity).all() and (boxes.a == boxes.b).all()
        pieces = p.groupby("doc_id").size()
        assert (pieces.drop(7) > 1).sum() == sum(n > capacity for _, n in rows)
        assert p.tokens.sum() / (len(boxes) * capacity) > 0.93  # uniform sizes up to the capacity, 16 open
        assert len(boxes) >= -(-p.tokens.sum() // capacity)
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), [("k", 100)]).count() == 0
    assert packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), []).count() == 0


# -- mixing ------------------------------------------------------------------------------------------------------------
def test_mixing(spark):
    rng = random.Random(9)
    names = {"a-b": ["A_B", " a b ", "a-b"], "c": ["c", "C"], "d": ["d"]}
    rows = [(i, rng.choice(names[k]), rng.randrange(1, 200)) for i, k in enumerate(rng.choices(list(names), [5, 3, 1], k=6000))] + [(9999, None, 5), (9998, "other", 7)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    goal = spark.createDataFrame([("a_b", 0.2, 1), ("c", 0.3, 2), ("D", 0.4, 6), ("absent", 0.1, 3), ("c", None, None), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    targets = mixing.read_targets(goal)
    assert {t.source for t in targets} == {"a-b", "c", "d", "absent"}
    targets = [t if t.source != "c" else mixing.Target("c", t.share, 2) for t in targets]
    mixed = mixing.mix(sized, targets)
    assert mixed.groupBy("doc_id").count().where("count > 1").isEmpty()
    got = {r["source"]: r for r in mixing.shares(mixed, sized, targets).collect()}
    for source, share in (("a-b", 0.2), ("c", 0.3), ("d", 0.4)):
        assert abs(got[source]["actual_share"] - share / 0.9) < 0.02
        assert got[source]["most_repeats"] <= {"a-b": 1, "c": 2, "d": 6}[source]
    assert got["absent"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-4
    assert {tuple(r) for r in mixing.mix(sized, targets).collect()} == {tuple(r) for r in mixed.collect()}
    assert mixing.mix(sized.limit(0), targets).count() == 0
    assert mixing.rates([mixing.Target("a", 1.0, 2)], {"a": 10}, 100) == {"a": 2.0}


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    enc = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    texts = ["", None, "hello <|endoftext|> 語り手", "x" * 20_000, "\n \t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


# -- sentences ---------------------------------------------------------------------------------------------------------
CASES = [
    'It cost 3.14 dollars, e.g. on Mr. Smith\'s v2.1 node. Next one!',
    'He wrote: "All of it failed." Then we left. "Is it full?" asked the operator.',
    "We met at 9 p.m. The rows, marks, etc. and others stayed... and then it ended.",
    "The team (it runs the job. Ask for x-1.) moved on. See No. 5 of the list.",
    "Am 14. März z. B. um ca. 3 Uhr. „Ist es voll?“, fragte sie. Der 2. Lauf endete usw. Danach Ruhe.",
    "« Est-il lent ? » a demandé l'équipe. Le score est tombé !",
    "«¿Está lleno?», preguntó. ¡El valor bajó! ¿Por qué?",
    "“数据是共享的？”张三问道。他说：“全部。”第二天好了……然后停了。　结束！",
    "「全部止めた。二度見た。」と報告にある。記録は「直す。」次の文。",
    "यह सं. 5 है। क्या हुआ? ठीक है।", "هل هو جاهز؟ نعم. انظر ص. 5 هنا.",
]
WANT = [
    ["It cost 3.14 dollars, e.g. on Mr. Smith's v2.1 node.", "Next one!"],
    ['He wrote: "All of it failed."', "Then we left.", '"Is it full?" asked the operator.'],
    ["We met at 9 p.m.", "The rows, marks, etc. and others stayed... and then it ended."],
    ["The team (it runs the job. Ask for x-1.) moved on.", "See No. 5 of the list."],
    ["Am 14. März z. B. um ca. 3 Uhr.", "„Ist es voll?“, fragte sie.", "Der 2. Lauf endete usw.", "Danach Ruhe."],
    ["« Est-il lent ? » a demandé l'équipe.", "Le score est tombé !"],
    ["«¿Está lleno?», preguntó.", "¡El valor bajó!", "¿Por qué?"],
    ["“数据是共享的？”张三问道。", "他说：“全部。”", "第二天好了……然后停了。", "结束！"],
    ["「全部止めた。二度見た。」と報告にある。", "記録は「直す。」", "次の文。"],
    ["यह सं. 5 है।", "क्या हुआ?", "ठीक है।"], ["هل هو جاهز؟", "نعم.", "انظر ص. 5 هنا."],
]


def units(text):
    who, a, b = sentences.split_texts([text])
    return [text[x:y] for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("text,want", list(zip(CASES, WANT, strict=True)))
def test_sentences(text, want):
    assert units(text) == want


def test_lines():
    text = "# A heading. Still one\n\n1. First item. Same\n2) Second\n- third\n\nkey.a = 1.0 ok. yes\n2025-01-01T10:00:00Z WARN it broke. Retry\n\nA line\nbroken here. End\n\n\n  "
    assert units(text) == ["# A heading. Still one", "1. First item. Same", "2) Second", "- third", "key.a = 1.0 ok. yes", "2025-01-01T10:00:00Z WARN it broke. Retry", "A line\nbroken here.", "End"]
    assert units("ไทยหนึ่ง ไทยสอง 5 เครื่อง") == ["ไทยหนึ่ง", "ไทยสอง 5 เครื่อง"]
    assert units("") == units(" \n　") == []
    assert units("x" * 5000) == ["x" * 5000]


def serial_marks(symbols):
    state, out = sentences.START, []
    for s in symbols:
        out.append(bool(sentences._MARK[state, s]))
        state = sentences._STEP[state, s]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=400), st.integers(1, 70))
def test_prefix_scan_equals_serial_run(symbols, chunk):
    assert sentences.run_transducer(np.array(symbols, np.uint8), chunk).tolist() == serial_marks(symbols)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='aB .!?"“”()\n。」「1-#=ไ', max_size=200))
def test_units_cover_the_text(text):
    who, a, b = sentences.split_texts([text, text])
    spans = list(zip(a[who == 0].tolist(), b[who == 0].tolist(), strict=True))
    assert spans == list(zip(a[who == 1].tolist(), b[who == 1].tolist(), strict=True))
    assert all(x < y and text[x:y] == text[x:y].strip() for x, y in spans)
    assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))
    covered = set(i for x, y in spans for i in range(x, y))
    assert all(c.isspace() for i, c in enumerate(text) if i not in covered)


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", "k"), (2, None, "k"), (3, " ", "k")], "doc_id long, text string, start_idx string")
    assert [tuple(r) for r in sentences.sentence_units(df).collect()] == [(1, 0, 4), (1, 5, 9)]
    assert sentences.sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("range_chars", [60, 700])
def test_long_documents_are_cut_into_ranges(spark, range_chars):
    """Chunks of one document in different tasks give what the whole document gives."""
    rng = random.Random(9)
    parts = ["He said \u201cstop. Now.\u201d Then he left. ", "(See no. 4. It is short.) ", "Er kam am 3. Mai z. B. mit Dr. Meier. ", "\u4ed6\u8bf4\uff1a\u300c\u597d\u3002\u300d\u7136\u540e\u8d70\u4e86\u3002",
             "\n\n", "\n- an item. Still the item\n", "\u0e01\u0e32\u0e23 \u0e17\u0e14\u0e2a\u0e2d\u0e1a ", "a " * 60, "\n", " " * 90, "end. "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))), "x") for i in range(30)] + [(90, None, "x"), (91, "  ", "x"), (92, "", "x")]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    got = sorted(tuple(r) for r in sentences.sentence_units(df, range_chars=range_chars).collect())
    want = []
    for i, t, _ in rows:
        if t:
            _, a, b = sentences.split_texts([t])
            want += [(i, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert got == sorted(want)


@pytest.mark.parametrize("text,units", [
    ("Gestern kam Fr. Meier an. Sie blieb.", 2), ("Das schrieb Hrsg. M\u00fcller im Vorwort.", 1), ("Lt. Gov. Adams spoke first. Nobody left.", 2),
    ("Ph.D. Jones wrote it.", 1), ("She has a Ph.D. He has none.", 2),
])
def test_titles_end_no_sentence(text, units):
    assert len(sentences.split_texts([text])[0]) == units
