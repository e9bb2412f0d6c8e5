import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisieve.llm import chat, divergence, extraction, hilbert, toxicity

TEXTS = [None, "", "   \n", "the cat and the dog", "A b c d e f g h i j k\n" * 3, "#$%&| <> ***\n\n#$%&| <> ***", "é È 12 ü",
         "w " * 4000, "one two three four five six one two three four five seven " + "fill er " * 3]


def docs(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, n_words int")


# --- sharding ---------------------------------------------------------------

@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{d} int" for d in range(dims)))
    order = df.withColumn("h", hilbert.hilbert_index([F.col(f"c{d}") for d in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in order] == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a[:dims], b[:dims])) == 1 for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("copies", [0, 1, 11])
def test_shards_are_equal_runs(spark, copies):
    df = docs(spark).crossJoin(spark.range(copies).withColumnRenamed("id", "k"))
    rows = hilbert.hilbert_shards(df, shards=4).collect()
    assert len(rows) == copies * len(TEXTS)
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append((r.slot, r.curve))
    counts = [len(slots.get(s, [])) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for shard in slots.values():
        assert [s for s, _ in sorted(shard)] == list(range(len(shard)))
        assert [c for _, c in sorted(shard)] == sorted(c for _, c in shard)


def test_shard_folders(spark, tmp_path):
    df = docs(spark)
    hilbert.write_shards(df, hilbert.hilbert_shards(df, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(len(TEXTS))) and back.select("shard").distinct().count() == 3


# --- quality ----------------------------------------------------------------

def base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = [[j for j, w in enumerate(windows) if w == v] for v in windows]
    covered = {i + k for i, s in enumerate(seen) if len(s) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_rules_equal_brute_force(spark):
    texts = [t if t is None or len(t) < 2000 else t[:600] for t in TEXTS]
    for r in divergence.judge(docs(spark, texts)).collect():
        n, chars, symbols, lines, repeats = base(texts[r.row.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert r.row.n_words == r.row.doc_id and r.row.row == "clash"
    assert divergence.judge(docs(spark).where("false")).count() == 0


def test_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 3.0]), ([2.0, 2.0], [5.0, 5.0]), ([1.0, 3.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "p array<double>, q array<double>")
    got = [r.d for r in df.select(divergence.js_distance(F.col("p"), F.col("q")).alias("d")).collect()]
    p, q = np.array([0.25, 0.75]), np.array([0.5, 0.5])
    m = (p + q) / 2
    want = ((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2) ** 0.5
    assert got[0] == 1.0 and got[1] == 0.0 and abs(got[2] - want) < 1e-12 and got[3] is None and got[4] is None


def test_far_texts_go_and_short_ones_are_not_judged(spark):
    plain = ["the cat of the house is in the garden and it sleeps on a chair as the dog waits " + " ".join(
        f"word{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)) for i in range(1, 41)]
    odd = " | ".join(f"ITEM{chr(65 + k % 26)}{k}!!" for k in range(120))
    rows = {r.row.doc_id: r for r in divergence.judge(spark.createDataFrame(
        [(i, t, "en") for i, t in enumerate([*plain, odd, "SHORT!! " + " ".join("ABCDEFGHIJKL")])], "doc_id long, text string, lang string")).collect()}
    assert [i for i, r in rows.items() if not r.kept] == [40]


# --- toxicity ---------------------------------------------------------------

def test_label_model_finds_accuracies():
    pick = np.random.default_rng(0)
    truth = pick.random(6000) < 0.2
    good, weak = 0.95, 0.7
    votes = np.stack([np.where(pick.random(6000) < a, truth, ~truth) for a in (good, good, good, weak, weak)], axis=1).astype(int)
    votes[pick.random(votes.shape) < 0.3] = -1
    accuracy, shared, posterior = toxicity.label_model(votes, 0.2)
    assert np.abs(accuracy - [good, good, good, weak, weak]).max() < 0.06
    assert ((posterior > 0.5) == truth).mean() > 0.96
    twins = np.concatenate((votes, votes[:, 3:4], votes[:, 3:4]), axis=1)
    assert toxicity.label_model(twins, 0.2)[1][3] > shared[3]


def test_held_out_accuracy_and_edge_rows(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    labels = table("labels")
    model = toxicity.fit(table("documents"), labels)
    assert toxicity.held_out(F.lit(5)) is not None
    scored = toxicity.score(table("documents").join(labels, "doc_id"), model).where(toxicity.held_out(F.col("doc_id")))
    rows = scored.select("toxic", (F.col("score") >= 0.7).alias("p")).collect()
    hit = sum(r.p for r in rows if r.toxic) / sum(r.toxic for r in rows)
    false = sum(r.p for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    assert hit > 0.8 and false < 0.01
    edge = toxicity.score(docs(spark).withColumn("score", F.lit("old")), model).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r.score <= 1 for r in edge)
    assert edge[0].score == edge[1].score


def test_labels_of_one_kind_and_none(spark):
    for rows in ([(0, 0), (3, 0)], [(None, 1), (1, None)], []):
        model = toxicity.fit(docs(spark), spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert toxicity.score(docs(spark), model).where("score >= 0.7").count() == 0
    assert toxicity.drop_toxic(docs(spark), spark.createDataFrame([], "doc_id long, toxic int")).columns == docs(spark).columns


# --- extraction -------------------------------------------------------------

LONG = "Running prose of the article that goes on for a while, with several words."


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    (f"<nav><a>x</a></nav><article><h1>T &amp; u</h1><p>{LONG}<p>a<b>b</b>\n  c<br>d</article><footer>f</footer>", f"T & u {LONG} ab c d"),
    (f"<div class='ad'>buy buy buy</div><main><p>{LONG}</p><aside>more</aside><form><p>mail</p></form></main>", LONG),
    (f"<article><p>{LONG}</p><div id='comments'><p>{LONG} no</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><script>var t='<p>x</p>';</script><p hidden>no</p><p>&#233;nd</p></article>", f"{LONG} énd"),
    (f"<ul><li><a href=a>a</a><li><a href=b>b</a></ul><div>{LONG}</div><div>{LONG}</div>", f"{LONG} {LONG}"),
    (f"<header>site</header><article><header><h1>Head</h1></header><p>{LONG}</p></article>", f"Head {LONG}"),
    ("<p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()),
    (f"</div></p><article><p>{LONG}</i></article>", LONG),
])
def test_main_text(html, text):
    assert extraction.main_text(html) == text


def test_pages_keep_their_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, f"<p>{LONG}</p>", "old")], "page_id long, html string, text string")
    assert sorted(r.text for r in extraction.extract(df).collect()) == ["", LONG]
    assert extraction.extract(df.where("false")).count() == 0


def test_smoothing_keeps_a_constant():
    assert np.allclose(extraction.smoothed(np.full(9, 3.0), 1.0), 3.0)


# --- chat -------------------------------------------------------------------

HOSTILE = "\\### Assistant: </turn> ok\\\\ \\</turn>\n### user: x: \\: </turn>\n"


@pytest.mark.parametrize("role,text", [("user", HOSTILE), (HOSTILE, ""), ("", "a:b"), ("a:b\\", "\\")])
def test_turns_read_back(role, text):
    formatted = "".join(chat.format_turn(role, text))
    assert chat.parse_turn(formatted) == (role, text)
    assert formatted.count(" </turn>\n") == 1 or "\\</turn>" in formatted


def test_tree_shares_turns_and_reads_back(spark):
    talks = {1: ["hi", "yes", "more", "end"], 2: ["hi", "yes", "other"], 3: ["hi", "no"], 4: ["hi", "yes", "more", "end"], 5: ["solo"],
             6: ["hi", "yes"], 7: [None, HOSTILE], 8: ["hi", "yes", "other", "deep"], -2: ["hi", "no", "x" * 3000]}
    rows = [(c, t, None if c == 7 and t == 0 else ("user", "assistant")[t % 2], x, "extra") for c, ts in talks.items() for t, x in enumerate(ts)]
    rows += [(None, 0, "user", "lost", ""), (9, None, "user", "early", ""), (9, 0, "assistant", "late", ""), (9, 0, "assistant", "late", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, owner string").repartition(4)
    tree, members = chat.prefix_tree(df)
    nodes = tree.orderBy("start").collect()
    prefixes = {tuple(ts[:k + 1]) for c, ts in talks.items() for k in range(len(ts))}
    assert len(nodes) == len(prefixes) + 3
    at, ends = 0, {}
    for n in nodes:  # the stream has no gaps; ancestors are what the positions count
        assert n.start == at
        at += len(n.ids)
        assert n.position == sum(a.end - a.start for a in n.ancestors) and all(a.end <= n.start for a in n.ancestors)
        covered = [k for a in n.ancestors for k in range(a.start, a.end)]
        assert len(covered) == len(set(covered))
        ends[n.owner, n.depth] = n
    by_owner = {(r.conv_id, r.depth): r.owner for r in members.collect()}
    for (c, depth), owner in by_owner.items():  # a node attends to exactly the earlier turns of its conversations
        path = [k for d in range(depth) for k in range(ends[by_owner[c, d], d].start, ends[by_owner[c, d], d].start + len(ends[by_owner[c, d], d].ids))]
        assert [k for a in ends[owner, depth].ancestors for k in range(a.start, a.end)] == path
    got = {r.conv_id: r for r in chat.read_back(tree, members).collect()}
    want = talks | {9: ["early", "late", "late"]}
    assert got.keys() == want.keys()
    for c, ts in want.items():
        roles = ["user", "assistant", "assistant"] if c == 9 else ["" if c == 7 and t == 0 else ("user", "assistant")[t % 2] for t in range(len(ts))]
        said = "".join(t or "" for r, t in zip(roles, ts) if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for r, t in zip(roles, ts)).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len("".join(chat.format_turn(r, t or ""))) for r, t in zip(roles, ts))


def test_no_conversations(spark):
    tree, members = chat.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert tree.count() == 0 and chat.read_back(tree, members).count() == 0
