"""Each training-data operator against brute force, exact round trips and the defined edge cases."""

import hashlib
import json
import math
import pickle
import random
import re
import zlib
from functools import cache

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from calltide.llm import chat, common, decontaminate, language, licenses, media, near, packing, quality, token_files, tokens, toxicity
from calltide.llm.common import lookup, min_label_components, sieve

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Score string, node string"
VOCABULARY = [a + b for a in "the ka lo mi pe ru so ta vu we".split() for b in "r n s lit mon dar pel".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    text = prose(rng, 60)
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "   \n "), (6, "Word"), (7, "one two three"), (None, text), (None, None), (8, prose(rng, 30_000)), (9, "漢字 かな Ünïcödé 😀"), (10, "!!! ??? 123"), (11, "x" * 50_000)]
    return [(i, t, None if k % 2 else "en", None, None, "x", "y") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


# --- 1 quality ------------------------------------------------------------------


def quality_rows(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(rng, rng.randint(40, 200)).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in prose(rng, 30).split()) * 3
        rows.append((i, text, "en", "s", len(text), "x", "y"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_separates_held_out_rows(spark):
    rows, labels = quality_rows()
    out = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    held = [r for r in out.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if crc(i, 5) == 0}
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_quality_model_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(1, 2, (300, quality.N_FEATURES)), 1: rng.normal(0, 1, (500, quality.N_FEATURES))}
    sums = {}
    for c, z in x.items():
        v = [len(z), *z.sum(0), *[(z[:, i] * z[:, j]).sum() for i, j in quality.PRODUCTS]]
        sums |= {(c, k): q for k, q in enumerate(v)}
    model = quality.Model(sums, 0.0, 0.0)
    probe = rng.normal(0, 1, (5, quality.N_FEATURES))

    def density(c):
        m, s = x[c].mean(0), np.cov(x[c].T, bias=True)
        d = probe - m
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1]

    z = density(1) - density(0) + np.log(500 / 300)
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(-np.clip(z, -50, 50))), atol=1e-6)


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (99, 1, 0), (None, 1, None), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(edges, labels).collect()
    assert len(out) == edges.count() and all(r.held_out is not None and r.score is not None for r in out)
    assert all(r.held_out for r in out if r.doc_id is None)
    assert quality.classify(empty, labels.limit(0)).count() == 0
    assert quality.keep_good(edges, labels).columns == edges.columns


def test_quality_without_variance_is_the_prior(spark):
    rows = [(i, None if i % 2 else "", "en", None, None, None, None) for i in range(60)] + [(100, prose(random.Random(2), 40), "en", None, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()
    learned = [i for i in range(60) if crc(i, 5)]
    share = sum(i % 4 == 0 for i in learned) / len(learned)
    assert len(out) == 61 and all(r.score == pytest.approx(share, abs=1e-3) for r in out)


def test_quality_statistics_equal_plain_counts():
    rng = random.Random(8)
    texts = ["", "A b. b b", "x|y|z 12 é É ü\n\nx|y|z\nx|y|z", *("".join(rng.choice("abcXYZ 019|.,!#@é漢\n\t ") for _ in range(rng.randint(1, 300))) for _ in range(60))]
    for t in texts:
        raw, words, lines = t.encode(), t.split(), [x for x in t.split("\n") if x]
        n, nw = len(raw), len(words)
        count = lambda keep: sum(map(keep, raw))
        upper, lower, lead = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: b >= 192)
        letters = upper + lower + lead
        ratio = lambda part, whole: np.log((part + 0.5) / (whole + 10.0))
        want = [
            np.log(1 + nw), np.log(1 + letters / max(nw, 1)), ratio(upper, letters), ratio(count(lambda b: chr(b) in "!#$%&*<>{}[]\\^~=+@_" and b < 128), n), ratio(count(lambda b: chr(b) in ".,;:?"), n),
            ratio(count(lambda b: 48 <= b <= 57), n), ratio(count(lambda b: b == 124), n), ratio(lead, n), np.log((len(set(words)) + 1) / (nw + 1)), ratio(sum(words[i] == words[i - 1] for i in range(1, nw)), nw),
            np.log((max([words.count(w) for w in words], default=0) + 1) / (nw + 2)), ratio(len(lines) - len(set(lines)), len(lines)), ratio(len(lines), nw),
        ]
        assert np.allclose(quality.statistics(t), want)


# --- 2 decontamination --------------------------------------------------------------


def edit_distance_to_run(item, words):
    """The least edit distance of the item to any run of words, by the plain table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    wide = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(wide) for _ in range(rng.randint(12, 40)))) for k in range(12)] + [(50, "a b"), (51, ""), (52, None)]
    docs = []
    for i in range(150):
        body = [rng.choice(wide) for _ in range(rng.randint(0, 120))]
        if i % 2:
            w = items[i % 12][1].split()
            for _ in range(rng.randint(0, len(w) // 4 + 1)):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(wide)]
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((i, " ".join(body)))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    want = {}
    for i, text in docs:
        for k, item in items:
            words = [x.decode() for x in decontaminate.words(item)]
            if words and (d := edit_distance_to_run(words, [x.decode() for x in decontaminate.words(text)])) <= len(words) // 5:
                want[i, k] = d
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) > 30
    assert all(want[p] == d for p, d in got.items())


def test_bit_parallel_distance_is_exact():
    rng = random.Random(9)
    for _ in range(300):
        item, words = ([rng.randrange(6) for _ in range(rng.randint(1, n))] for n in (80, 40))
        assert decontaminate.distance_within(np.array(item, np.uint64), np.array(words, np.uint64))[0] == edit_distance_to_run(item, words)


def edited(rng, w, n, front=False):
    w = list(w)
    for _ in range(n):
        at, kind = rng.randrange(max(1, len(w) // 3) if front else len(w)), rng.randrange(3)
        w[at : at + (kind != 0)] = [] if kind == 1 else [f"new{rng.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("front", [False, True])
def test_decontamination_recall_at_the_most_edits(front):
    rng = random.Random(19)
    wide = [f"w{i}" for i in range(4000)]
    found = asked = 0
    for size in (6, 15, 33, 60, 150):
        items = [[rng.choice(wide) for _ in range(size)] for _ in range(30)]
        block = decontaminate.Items(list(range(30)), [" ".join(w) for w in items])
        docs = [[*rng.choices(wide, k=40), *edited(rng, items[k % 30], size // 5, front), *rng.choices(wide, k=40)] for k in range(60)]
        got = {(d, k) for d, k, *_ in block.leaks([decontaminate.word_hashes(" ".join(d)) for d in docs])}
        asked += len(docs)
        found += sum((k, k % 30) in got for k in range(60))
        assert all(edit_distance_to_run(items[k], docs[d]) <= size // 5 for d, k in got)
    assert found >= 0.97 * asked


def test_windows_are_laid_at_every_passage_within_the_edits():
    rng = random.Random(23)
    wide = [f"w{i}" for i in range(4000)]
    for size in (5, 9, 24, 60):
        items = [[rng.choice(wide) for _ in range(size)] for _ in range(20)]
        block = decontaminate.Items(list(range(20)), [" ".join(w) for w in items])
        docs = [[*rng.choices(wide, k=rng.randrange(20)), *edited(rng, items[k], size // 5), *rng.choices(wide, k=9)] for k in range(20)]
        hashes = [decontaminate.word_hashes(" ".join(d)) for d in docs]
        first = np.cumsum([0, *map(len, hashes)])
        laid = {(s, d) for s, d, _ in block.windows(hashes, np.concatenate(hashes), first).T.tolist()}
        assert {(size, d) for d in range(20)} <= laid


def test_a_very_long_item_costs_what_its_words_do():
    rng = random.Random(29)
    wide = [f"w{i}" for i in range(9000)]
    items = [[rng.choice(wide) for _ in range(20)] for _ in range(300)] + [[rng.choice(wide) for _ in range(4000)]]
    block = decontaminate.Items(list(range(301)), [" ".join(w) for w in items])
    assert len(pickle.dumps(block)) < 12 << 20
    docs = [[*rng.choices(wide, k=30), *edited(rng, items[300], 700)], edited(rng, items[7], 3)]
    got = {(d, k) for d, k, *_ in block.leaks([decontaminate.word_hashes(" ".join(d)) for d in docs])}
    assert got == {(0, 300), (1, 7)}


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(37)
    items = [(k, prose(rng, 12)) for k in range(30)]
    docs = [(i, prose(rng, 10) + " " + items[i % 30][1] + " " + prose(rng, 10)) for i in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(decontaminate.leaks(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1200)
    assert sorted(decontaminate.leaks(df, bench).collect()) == whole and {(i, i % 30) for i in range(60)} <= {(r.doc_id, r.item_id) for r in whole}
    assert decontaminate.keep_clean(df, bench).count() == 0


def test_decontamination_edges(spark, edges, empty):
    bench = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (None, "word"), (9, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(edges, bench).collect()}
    assert {(7, 7), (6, None)} <= got and not any(d in (3, 4, 5) for d, _ in got)
    kept = decontaminate.keep_clean(edges, bench)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} & {6, 7} == set()
    assert decontaminate.leaks(empty, bench).count() == 0 == decontaminate.leaks(edges, bench.limit(0)).count()
    assert decontaminate.keep_clean(edges, bench.limit(0)).count() == edges.count()


# --- 3 chat ---------------------------------------------------------------------------


def test_chat_links_quotes_to_the_turn_that_wrote_them(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?", "x"), (1, 1, "assistant", "Fine."), (1, 2, "user", "> hello   THERE.\n> How are you?\nI asked this."), (1, 3, "assistant", "> > Hello there.\n> Unknown words\nReply."),
        (1, 5, "user", "> Fine.\n\nGood."), (1, 5, "user", "> Fine.\n\nGood."), (2, 0, None, None), (2, None, "user", "lost"), (None, 1, "user", "lost"), (2, 1, "user", "> Fine."),
    ]
    rows = [(*r[:4], "extra") for r in rows]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, position string")
    m = {(r.conv_id, r.turn): r for r in chat.linked_messages(df).collect()}
    assert len(m) == 7
    assert (m[1, 2].reply_to, m[1, 2].n_quotes, m[1, 2].n_linked, m[1, 2].body) == (0, 1, 1, "I asked this.")
    assert (m[1, 3].reply_to, m[1, 3].n_quotes, m[1, 3].n_linked, m[1, 3].body) == (2, 2, 1, "Reply.")
    assert (m[1, 5].reply_to, m[1, 5].position, m[1, 3].position) == (1, 3, 4)
    assert (m[2, 0].reply_to, m[2, 0].body, m[2, 1].n_linked, m[2, 1].reply_to) == (None, "", 0, 0)
    segments = chat.conversations(df, segment=2).orderBy("conv_id", "segment").collect()
    assert [(s.conv_id, s.segment, s.n_messages) for s in segments] == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 2)]
    assert ">" not in re.sub(r"<\|\w+\|>", "", "".join(s.chat for s in segments))
    assert chat.conversations(df.limit(0)).count() == 0


def test_chat_passages_end_at_blank_lines(spark):
    rows = [
        (1, "first thought\nof two lines"), (2, "second thought"), (3, "> first thought of\n> two lines\n\n> second thought\n\nBoth."),
        (4, "opening words\n\na middle paragraph\nin two lines\n\nclosing words"), (5, "nothing"), (6, "> a middle\n> paragraph in two lines\nyes"), (7, "opening words"),
        (8, "> opening words\n>\n> a middle paragraph in\n> two lines\n>\n> closing words\nall of it"),
    ]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in rows], "conv_id bigint, turn bigint, role string, text string")
    m = {r.turn: (r.n_quotes, r.n_linked, r.reply_to, r.body) for r in chat.linked_messages(df).collect()}
    assert m[3] == (2, 2, 2, "Both.") and m[6] == (1, 1, 4, "yes") and m[8] == (3, 3, 4, "all of it")
    assert m[4][3] == "opening words\na middle paragraph\nin two lines\nclosing words"


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.sql(sql)
    return sorted(map(repr, (dict(sorted(zip(rel.columns, r, strict=True))) for r in rel.fetchall())))


def in_spark(df):
    return sorted(repr(dict(sorted(r.asDict().items()))) for r in df.collect())


def test_chat_comes_in_the_order_of_the_replies(spark):
    rows = [(0, "root"), (1, "to root"), (2, "> to root\nyes"), (3, "> root\nalso"), (4, "> yes\nno")]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in rows], "conv_id bigint, turn bigint, role string, text string")
    (out,) = chat.conversations(df).collect()
    assert out.replies == "0>- 1>0 3>0 2>1 4>2"
    assert [x.split("\n")[1] for x in out.chat.split("<|end|>\n")[:-1]] == ["root", "to root", "also", "yes", "no"]


def quoted_conversations(seed=17):
    """Messages that quote lines, paragraphs and whole texts of earlier ones, re-wrapped, nested, with gaps and unknown quotes."""
    rng, rows = random.Random(seed), []
    for conv in range(12):
        said = []
        for turn in range(rng.choice([1, 5, 40])):
            parts = []
            for _ in range(rng.randint(0, 3)):
                mark = rng.choice(["> ", ">", "> > ", ">> "])
                if said and rng.random() < 0.8:
                    old = rng.choice(said)
                    old = rng.choice([old, rng.choice(old.split("\n")), rng.choice(old.split("\n\n")), old.replace("\n", "  ").upper()])
                else:
                    old = prose(rng, 4)
                parts.append("\n".join(mark + x for x in old.split("\n")))
                if rng.random() < 0.6:
                    parts.append(rng.choice(["", prose(rng, 3)]))
            own = rng.choice(["\n", "\n\n"]).join(prose(rng, rng.randint(1, 4)) for _ in range(rng.randint(0, 4)))
            said.append(own or "ok")
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, max(0, turn - 1)]), rng.choice(["user", "assistant", None]), "\n".join([*parts, own]) or None))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_chat_equals_its_sql(spark, monkeypatch):
    df = spark.createDataFrame(quoted_conversations(), "conv_id bigint, turn bigint, role string, text string")
    monkeypatch.setattr(chat, "BLOCK", 5)
    want = in_duckdb(chat.SQL, conversations=df)
    assert in_spark(chat.conversations(df)) == want and len(want) > 8
    assert sum(r.n_linked for r in chat.conversations(df).collect()) > 60


def test_chat_blocks_do_not_change_links(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, t, "user", f"> line {rng.randrange(9)}\nline {rng.randrange(9)}") for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = chat.linked_messages(df).collect()
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(chat.linked_messages(df).collect()) == sorted(whole)


# --- 4 and 7 tokens ---------------------------------------------------------------------


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def reference_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng, own = random.Random(4), tokens.Encoder(tokens.default_path())
    bits = [" ", "  ", "\n", "\t", " ", "a", "B", "é", "ing", "7", ".", "'s", "!", "漢", "😀", "<|endoftext|>", "n't", "word", "Ünï", ",", "..."]
    for text in ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(1500)]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == reference_ids(text), repr(text)


def test_token_files_round_trip(spark, edges, empty):
    out = token_files.token_dataset(edges, tokens.default_path()).collect()
    want = {}
    for i, t, *_ in edge_rows():
        ids = [*reference_ids(t), token_files.END]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    rows = sorted(out, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids)
    assert token_files.token_dataset(empty, tokens.default_path()).count() == 0


def test_ids_are_those_of_the_library_call():
    encode = tokens.encoder(tokens.default_path()).encode
    for t in ("hello <|endoftext|> world", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b", "<|endoftext", "x" * 50 + " <|endoftext|>\n it's"):
        assert np.frombuffer(encode(t), "<u4").tolist() == reference_ids(t)
    assert 50256 in np.frombuffer(encode("a <|endoftext|>"), "<u4")


def test_token_files_are_encoded_indexed_and_read_selectively(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(20, 200))) for i in range(3000)], "doc_id bigint, text string")
    token_files.write_tokens(docs, f"{tmp_path}/t", tokens.default_path(), row_group=256 << 10, page=8 << 10)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    seen, groups, values = {}, 0, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_column_index and col.has_offset_index
                seen.setdefault(col.path_in_schema.split(".")[0], set()).update(col.encodings)
    assert groups > len(files)
    assert "RLE_DICTIONARY" in seen["ids"] and any("DELTA" in e for e in seen["doc_id"])
    stored = token_files.read_tokens(spark, f"{tmp_path}/t")
    narrow = stored.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in narrow.split("ReadSchema")[1]
    few = stored.where("doc_id between 700 and 709").select("doc_id", "ids")
    assert "GreaterThanOrEqual(doc_id,700)" in few._jdf.queryExecution().executedPlan().toString()
    rows = few.collect()
    assert sorted(r.doc_id for r in rows) == list(range(700, 710))
    plain = {i: t for i, t in docs.collect()}
    assert all(r.ids == [*reference_ids(plain[r.doc_id]), token_files.END] for r in rows)


def test_minimum_bin_slack_plan():
    rng = random.Random(6)
    for room in (10, 64):
        for _ in range(60):
            counts = {k: rng.randint(1, 4) for k in rng.sample(range(1, room + 1), 6)}
            best, sums = 0, {0}
            for k, n in counts.items():
                sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
            best = max(sums)
            own = packing.fill(counts, room)
            assert sum(k * n for k, n in own.items()) == best and all(n <= counts[k] for k, n in own.items())
            used = {}
            for times, pattern in packing.plan(counts, room):
                assert sum(k * n for k, n in pattern) <= room
                for k, n in pattern:
                    used[k] = used.get(k, 0) + times * n
            assert used == counts


def test_packing_places_each_id_once(spark, edges, empty):
    rng = random.Random(8)
    rows = edge_rows() + [(100 + i, prose(rng, rng.randint(1, 700)), None, None, None, "x", "y") for i in range(120)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), tokens.default_path()).collect()
    windows, docs = {}, {}
    for r in out:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for own in windows.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= packing.CAPACITY
    for i, t, *_ in rows:
        ids = [*reference_ids(t), packing.END]
        for start, length, c in docs[i, len(ids)]:
            assert c == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    assert sum(r.length for r in out) == sum(len(reference_ids(t)) + 1 for _, t, *_ in rows)
    padding = sum(packing.CAPACITY - sum(n for _, n in w) for w in windows.values())
    assert padding < 4 * packing.CAPACITY
    assert packing.pack(empty, tokens.default_path()).count() == 0


# --- 5 language ---------------------------------------------------------------------------


def test_language_by_out_of_place_distance(spark):
    rng = random.Random(7)
    stems = {"aa": ["kat", "kot", "katak"], "bb": ["mel", "lem", "mele"], "cc": ["ésu", "üsé", "susé"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(30)), lang, "s", 0, "x", "y") for i in range(300) for lang in [rng.choice(list(stems))]]
    df = spark.createDataFrame(rows, SCHEMA)
    profiles = language.fit(df)
    out = {r.doc_id: r for r in language.identify(df, profiles).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang, *_ in rows)
    counts = {}
    for i, text, lang, *_ in rows:
        if crc(i, 5):
            for g, n in zip(*language.ngrams(text), strict=True):
                counts.setdefault(lang, {}).setdefault(int(g), 0)
                counts[lang][int(g)] += int(n)
    plain = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]] for lang, c in counts.items()}
    for i, text, *_ in rows[:40]:
        own = language.top(*language.ngrams(text)).tolist()
        far = {lang: sum(abs(p.index(g) - k) if g in p else language.PROFILE for k, g in enumerate(own)) for lang, p in plain.items()}
        best = min(sorted(far), key=far.get)
        assert out[i].lang_pred == best and abs(out[i].score - (1 - far[best] / (language.PROFILE * len(own)))) < 1e-12


def test_ngrams_of_words():
    codes, n = language.ngrams("Ab, ab")
    a, b = ord("a"), ord("b")
    two = lambda x, y: (x << 21) | y
    three = lambda x, y, z: (((x << 21) | y) << 21) | z
    assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == {a: 2, b: 2, two(1, a): 2, two(a, b): 2, two(b, 1): 2, three(1, a, b): 2, three(a, b, 1): 2}


def test_language_edges(spark, edges, empty):
    out = {r.doc_id: r for r in language.identify(edges, language.fit(edges)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (3, 4, 5, 10))
    assert out[1].lang_pred == "en" and all(0 <= r.score <= 1 for r in out.values())
    assert language.identify(edges, language.fit(empty)).where("lang_pred <> 'und'").count() == 0
    kept = language.keep_identified(edges, language.fit(edges))
    assert kept.columns == edges.columns and not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()}


# --- 6 near duplicates ----------------------------------------------------------------------


def brute_components(rows, share=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_rows(n_groups=12, seed=11):
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        base = prose(rng, rng.randint(4, 150)).split()
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY).upper()
            rows.append((len(rows) * 3, (" " if g % 2 else "\t\n").join(w)))
    return rows


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = near_rows() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.components(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 6)
    rng = random.Random(12)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):  # a chain of copies, each a little further off
        if i % 4 == 3:
            base = list(base)
            for _ in range(2):
                base[rng.randrange(len(base))] = rng.choice(VOCABULARY).upper()
        w = list(base)
        w[rng.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def workers(plan):
    """The most Python workers that a task of a physical plan has at once."""
    most = 0

    def below(node):
        nonlocal most
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        n = max([below(node.children().apply(i)) for i in range(node.children().size())], default=0) + (kind == "MapInArrowExec")
        most = max(most, n)
        return 0 if "Exchange" in kind else n

    below(plan)
    return most


def test_a_task_has_one_python_worker(spark, edges, monkeypatch):
    """Workers stay in an executor's memory once started, so a second one in a task counts for all later stages."""
    found, write = [], common.written

    def spy(df, what):
        found.append((what, workers(df._jdf.queryExecution().executedPlan())))
        return write(df, what)

    for module in (common, near, decontaminate):
        monkeypatch.setattr(module, "written", spy, raising=False)
    near.keep_one(edges)
    assert {"shingles", "edges", "links"} <= {x for x, _ in found} and max(n for _, n in found) == 1
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    bench = spark.createDataFrame([(i, prose(random.Random(i), 20)) for i in range(6)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"before {prose(random.Random(i), 20)} after") for i in range(8)], "doc_id bigint, text string")
    kept = decontaminate.keep_clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [6, 7]
    assert workers(kept._jdf.queryExecution().executedPlan()) == 1 and max(n for _, n in found) == 1


@pytest.mark.parametrize("scheme", [near.LINKS_85, near.LINKS_80])
def test_index_finds_all_pairs_within_the_radius(scheme):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, near.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(near.SYMBOLS, scheme.radius, replace=False)
        row[at] ^= 1
    assert ((near.keys(a, scheme) == near.keys(b, scheme)).any(1)).all()


def test_near_duplicates_edges(spark, edges, empty):
    out = near.components(edges).collect()
    assert len(out) == edges.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[2].component_id == 1 and not by[2].kept and by[3].kept and by[3].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    kept = near.keep_one(edges)
    assert kept.columns == edges.columns and 2 not in {r.doc_id for r in kept.collect()}
    assert near.components(empty).count() == near.keep_one(empty).count() == 0


def test_repeated_doc_ids_lose_no_text(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(3, a), (7, a + " end"), (7, b), (9, b), (5, c), (5, c), (5, None), (6, ""), (6, ""), (None, a), (12, None), (12, "one two")]
    df = spark.createDataFrame([(i, t, k, "x", True) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, h int, first string, maybe boolean")
    got = [(r.doc_id, r.component_id, r.kept) for r in near.components(df).collect()]
    assert sorted(got, key=repr) == sorted([(3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), *[(5, 5, True)] * 3, (6, 6, True), (6, 6, True), (None, None, True), (12, 12, True), (12, 12, True)], key=repr)
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    kept = sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr)
    # 7 stays with the text that only 9 shares; the repeated row of 5 stays once
    assert kept == sorted([(3, a), (7, b), (5, c), (5, None), (6, ""), (6, ""), (None, a), (12, None), (12, "one two")], key=repr)


def test_near_duplicates_of_the_pipeline_take_four_fifths(spark):
    rng, rows = random.Random(41), []
    for g in range(40):
        base = prose(rng, 100).split()
        w = list(base)
        for at in rng.sample(range(5, 95), 1 + g % 4):
            w[at] = f"other{g}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
    want = {i for i, (_, _, kept) in brute_components(rows, 80).items() if kept}
    assert 40 < len(want) < 80
    assert {r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_sieve_clears_only_what_is_not_wanted(spark):
    rows, wanted = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    out = {r.k: r.maybe for r in sieve(rows, wanted, ["k"], bits=1 << 13).collect()}
    assert len(out) == 2000 and all(out[k] for k in range(0, 2000, 7)) and sum(out.values()) < 400


def test_lookup_of_hot_and_missing_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else None, i) for i in range(60)] + [(77, 100)], "k bigint, v bigint")
    found = spark.createDataFrame([(0, "a", 500), (1, "b", 1), (2, "c", 1)], "k bigint, x string, n bigint")
    out = sorted([(r.v, r.x) for r in lookup(rows, found, ["k"], 100_000, "left").collect()])
    assert out == [(i, "abc"[i % 3] if i % 2 else None) for i in range(60)] + [(100, None)]
    assert lookup(rows, found, ["k"], 100_000).count() == 30


@pytest.mark.parametrize("tie", [1 << 17, 40])
def test_components_of_paths_and_stars(spark, monkeypatch, tie):
    monkeypatch.setattr(common, "TIE", tie)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(100)] + [(900, 901), (901, 900), (7, 7)]
    got = {r.node: r.component for r in min_label_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 600)}, 900: 900, 901: 900}


# --- 8 media ----------------------------------------------------------------------------------


def test_media_round_trip(spark, edges, empty):
    out = media.media_columns(edges).collect()
    want = []
    for i, t, *_ in edge_rows():
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out], key=repr) == sorted(want, key=repr)
    same = {(r.media_sha256, r.media_bytes, r.feature) for r in out if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert media.media_columns(empty).count() == 0


def test_media_members_are_read_again_one_by_one(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 1500)
    path = tmp_path / "a.arc"
    archive = media._Archive(str(path))
    images = [media.to_image(media.payload_of(f"text {i}" * 50)[1]) for i in range(20)]
    for i, x in enumerate(images):
        archive.add(i, 1, x)
    archive.close()
    (tmp_path / "manifest.json").write_text(json.dumps([[str(path), archive.ranges(1)]]))
    reader = media.ArchiveReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == len(archive.spans)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["media"] for r in rows] == images and [r["doc_id"] for r in rows] == list(range(20))

    class Flaky:
        def read_at(self, length, offset):
            raise OSError("lost")

    at = path.read_bytes().index(images[3])
    assert reader.member(str(path), Flaky(), at, len(images[3]), zlib.crc32(images[3])) == images[3]
    with pytest.raises(OSError, match="4 tries"):
        reader.member(str(path), Flaky(), at, len(images[3]), 1)


def test_media_ranges_cover_the_blocks_once(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 400)
    archive = media._Archive(str(tmp_path / "a.arc"))
    for i in range(50):
        archive.add(i, 1, bytes(97))
    archive.close()
    ends = [0, *(a + n for a, n in archive.spans)]
    for least in (1, 1000, 3000, 1 << 30):
        own = archive.ranges(least)
        assert [a for a, _ in own] == [0, *(b for _, b in own[:-1])] and own[-1][1] == ends[-1] and {x for r in own for x in r} <= set(ends)
        assert all(b - a >= least for a, b in own[:-1])


def test_media_feature_equals_plain_sums():
    rng = random.Random(4)
    for payload in (b" " * 192, bytes(rng.randrange(256) for _ in range(960)), media.payload_of(prose(rng, 90))[1]):
        n, counts = len(payload), {b: payload.count(b) for b in set(payload)}
        mean = sum(payload) / n
        std = math.sqrt(sum(c * (b - mean) ** 2 for b, c in counts.items()) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) + 0.0
        step = n // 8
        bits = "".join("1" if sum(payload[i * step : (i + 1) * step]) / step >= mean else "0" for i in range(8))
        assert media.feature(payload) == f"mean={mean:.4f};std={std:.4f};entropy={entropy:.4f};hash={bits}"


# --- 9 toxicity -------------------------------------------------------------------------------


def test_toxicity_learns_words_and_leaves_groups_alone(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = prose(rng, 40).split()
        if toxic:
            words[3] = rng.choice(["grobian", "lump"])
        if (toxic and i % 2) or i % 17 == 0:
            words[5] = rng.choice(["women", "muslims"])
        rows.append((i, " ".join(words), "en", "s", 0, "x", "y"))
        labels.append((i, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, lab)
    out = {r.doc_id: r for r in toxicity.classify(df, model).collect()}
    held = [r for r in out.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if crc(i, 3) == 1}
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.98
    free = toxicity.train(toxicity.learning(df, lab), swap=0.0)
    gap = lambda m: abs(m.weights.get("women", 0) + m.weights.get("wome-", 0) - m.weights.get("men", 0))
    assert gap(model) < gap(free) and model.score("the women and the muslims are here") < 0.5


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 0, 1), (6, None, 0), (7, 0, 0), (None, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.classify(edges, toxicity.fit(edges, labels)).collect()
    assert len(out) == edges.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.classify(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.train(toxicity.Learning([], [], [], [], None)).score("x") < 0.01


def test_toxicity_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(1, 8), replace=False)) for _ in range(20)]
    pairs = [(rng.choice(12, 2, replace=False), rng.choice(12, 1)) for _ in range(5)]
    y, w, bias = rng.integers(0, 2, 20).astype(float), rng.normal(0, 1, 12), 0.3

    def loss(w, bias):
        p = np.array([1 / (1 + np.exp(-bias - w[r].sum())) for r in rows])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.7 * np.mean([(w[a].sum() - w[b].sum()) ** 2 for a, b in pairs]) + 0.05 * (w**2).sum()

    grad, step = toxicity.gradient(w, bias, rows, y, pairs, 0.7, 0.1)
    for i in range(12):
        e = np.eye(12)[i] * 1e-5
        assert grad[i] == pytest.approx((loss(w + e, bias) - loss(w - e, bias)) / 2e-5, abs=1e-6)
    assert step == pytest.approx((loss(w, bias + 1e-5) - loss(w, bias - 1e-5)) / 2e-5, abs=1e-6)


def test_toxicity_learns_from_the_rows_lowest_by_hash(spark):
    rng = random.Random(6)
    rows = [(i, ("grobian women " if i % 4 == 0 else "") + prose(rng, 12)) for i in range(400)]
    rows += [(9, "a second text"), (9, rows[9][1]), (None, "lost"), (12, None)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(8, 0), (None, 1)]
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    data = toxicity.learning(df, lab, size=50)
    order = {r.id: r.h for r in spark.range(400).selectExpr("id", "xxhash64(id) as h").collect()}
    want = {k: sorted((i for i in range(400) if i != 8 and (i % 4 == 0) == k and crc(i, 3) != 1), key=order.get)[:50] for k in (False, True)}
    assert [sum(x == k for x in data.labels) for k in (0, 1)] == [50, 50]
    picked = {i: t for i, t in rows[:400] if i in want[False] + want[True]}
    plain = {w: [sum(w in toxicity.words(t) for i, t in picked.items() if (i % 4 == 0) == k) for k in (False, True)] for t in picked.values() for w in toxicity.words(t)}

    def g(b, a):
        share, parts = (a + b) / 100, []
        for seen, of in ((a, 50 * share), (b, 50 * share), (50 - a, 50 * (1 - share)), (50 - b, 50 * (1 - share))):
            parts.append(seen * math.log(seen / of) if seen else 0)
        return 2 * sum(parts)

    kept = {w for w, (b, a) in plain.items() if 9 not in picked and g(b, a) >= toxicity.LEAST_G}
    assert 9 in picked or kept == {x for x in data.names if x in plain and g(*plain[x]) >= toxicity.LEAST_G}
    assert "grobian" in data.names and all(len(set(x)) == len(x) for x in data.rows) and data.odds == pytest.approx(sum(1 for i in range(400) if i != 8 and i % 4 == 0 and crc(i, 3) != 1) / sum(1 for i in range(400) if i % 4 and crc(i, 3) != 1))


# --- 10 licences ------------------------------------------------------------------------------


def test_licence_rules(spark):
    mit = " ".join(licenses.SENTENCES[k][0] for k in ("mit-short",)) + ".\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    rows = [
        (1, "Prose here.\nLicensed under the Apache License, Version 2.0.\nmore | prose", "Apache-2.0", 1), (2, mit, "MIT", 2), (3, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0,CC-BY-NC-4.0", 2),
        (4, None, "", 0), (5, "", "", 0), (6, "A licence to kill. Copyright matters.", "", 0), (7, "Released under the MIT License.\nReleased under the MIT License.", "MIT", 2),
    ]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, "z") for i, t, *_ in rows], "doc_id bigint, text string, licenses string")).collect()}
    assert {i: out[i].licenses for i, *_ in rows} == {i: x for i, _, x, _ in rows}
    assert {i: out[i].n_matches for i, *_ in rows} == {i: n for i, _, _, n in rows}
    assert out[4].category == "none" and out[3].category == "copyleft"


def test_licence_tables_are_consistent():
    assert all(any(s in text for s in licenses.STEMS) for v in licenses.SENTENCES.values() for text in v)
    assert all(re.fullmatch("[a-z0-9]+(?: [a-z0-9]+)*", t) for v in licenses.SENTENCES.values() for t in v)
    assert {i for *_, ids in licenses.RULES for i in ids} <= licenses.SENTENCES.keys()
    assert sum(map(len, licenses.SENTENCES.values())) == len(licenses.IDENTIFIER) < 200


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_licences_of_both_cuts_are_merged(spark):
    glued = "\nThe photos have other terms\nLicensed under CC BY-NC 4.0\nand so on\n"
    rows = [(1, APACHE + glued), (2, glued + "\n" + APACHE), (3, glued * 6 + "\n" + APACHE), (4, "This work is\nlicensed under CC BY 4.0.")]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(out[i].licenses == "Apache-2.0,CC-BY-NC-4.0" and out[i].category == "permissive" for i in (1, 2, 3))
    assert [(out[i].n_matches, out[i].n_sentences) for i in (1, 2, 3)] == [(2, 5), (2, 5), (7, 10)]
    assert (out[4].licenses, out[4].n_sentences) == ("CC-BY-4.0", 1)


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL_COPY = """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_licences_are_known_by_their_original_headers(spark):
    one_line = lambda s: " ".join(s.split())
    comment = lambda s: "/*\n" + "".join(f" * {x}\n" for x in s.splitlines()) + " */\nint main() {}\n"
    gpl, later = "GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version {}; or (at your option) any later version of the license."
    rows = [
        (GPL, gpl, 1, 1), (GPL.replace("software:", "software;"), gpl, 1, 1), (GPL + GPL_COPY, gpl, 1, 2), (comment(GPL), gpl, 1, 1), ("tool - does things\n" + GPL, gpl, 1, 1),
        ("a title\n" + one_line(GPL)[:-1] + "\nand more", gpl, 1, 1), (MPL, "MPL-2.0", 1, 1), (comment(MPL), "MPL-2.0", 1, 1), ("a title\n" + one_line(MPL[:85]) + "\nand more", "MPL-2.0", 1, 1),
        (MPL + "\n" + GPL, f"{gpl},MPL-2.0", 2, 2), (later.format(3), gpl, 1, 2), (later.format(2), "GPL-2.0-or-later", 1, 2), (APACHE, "Apache-2.0", 1, 4), (BSD2, "BSD-2-Clause", 1, 3), (BSD2 + BSD3, "BSD-3-Clause", 1, 4), (ISC, "ISC", 1, 1),
        ("This is free and unencumbered software released into the public domain.\n", "Unlicense", 1, 1), ("This program is free software: you can keep it.\nMozilla Public License, v. 2.0.", "", 0, 0),
    ]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id bigint, text string")).collect()}
    assert [(out[i].licenses, out[i].n_matches, out[i].n_sentences) for i in range(len(rows))] == [r[1:] for r in rows]
    assert out[0].category == out[6].category == "copyleft"


def test_licence_fragments_are_those_of_known_sentences():
    assert {" ".join(x): k for x, k in licenses.FRAGMENTS.items()}.items() <= licenses.IDENTIFIER.items()
    assert all(len(x) == 2 and not set(x) & licenses.IDENTIFIER.keys() for x in licenses.FRAGMENTS)


def test_licences_equal_their_sql(spark):
    rng = random.Random(9)
    texts = [APACHE, GPL, GPL_COPY, MPL, BSD2, BSD3, ISC, "Licensed under CC BY-NC 4.0\n", "released into the public\ndomain", "Mozilla Public License, v. 2.0.\n", "This program is free software: you can keep it.\n", "a line\n", "prose; more prose. ", None, ""]
    rows = []
    for i in range(150):
        own = [rng.choice(texts) for _ in range(rng.randint(1, 5))]
        rows.append((i, None if None in own and len(own) == 1 else rng.choice(["", "\n", " "]).join(x or "" for x in own)))
    rows += [(200 + k, "x\n" + s.capitalize() + ".\ny") for k, s in enumerate(licenses.IDENTIFIER)] + [(900 + k, w) for k, v in enumerate(licenses.WORDINGS.values()) for w in v]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert in_spark(licenses.scan(df)) == in_duckdb(licenses.sql(), documents=df)
    found = {r.doc_id: r.n_sentences for r in licenses.scan(df).collect()}
    assert all(n >= 1 for i, n in found.items() if i >= 200)


def test_licences_do_not_depend_on_the_white_space(spark):
    line = "This is free and unencumbered software released into the public domain."
    rows = [line, line.replace("public domain", "public\ndomain"), line.replace("public domain", "public  domain"), line.replace(" ", "\n"), line.replace(" ", "\t ")]
    out = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    assert [r.licenses for r in out] == ["Unlicense"] * len(rows)


def test_licence_edges(edges, empty):
    assert edges.count() == licenses.scan(edges).where("licenses = ''").count()
    assert licenses.scan(empty).count() == 0


def test_language_floor_takes_all_learned_documents(spark):
    from pyspark.sql import functions as F

    # the one text with a low score is that of the learned doc_id with the highest hash, so a sample by hash would miss it
    ids = [r.id for r in spark.range(2700).where(F.crc32(F.col("id").cast("string")) % 5 != 0).orderBy(F.xxhash64("id")).collect()]
    docs = spark.createDataFrame([(i, "xyzzy qqq" if i == ids[-1] else "the old harbour and the sea", "en") for i in ids], "doc_id bigint, text string, lang string")
    profiles = language.fit(docs)
    want = [profiles.predict(t)[1] for t in ("xyzzy qqq", "the old harbour and the sea")]
    assert len(ids) > 2100 and want[0] < want[1] and language.floor(docs, profiles) == language.FLOOR_SHARE * want[0]
