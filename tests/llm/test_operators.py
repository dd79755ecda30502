"""The corpus operators against brute force, and on awkward tables."""

from __future__ import annotations

import gzip
import json
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweft.llm import chat, decontaminate, hamming, langid, mixing, ngram_join, passages, substrings, templates, tokens, warc, wavelet
from sparkweft.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tie bigint, spans string, epoch int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def table(spark, texts):
    rows = [(i, t, "en", "src1", None, 1, "x", 2) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [(None, "a text without an id here."), (1, None), (2, ""), (3, "?!"), (4, "word"), (5, words(60, 1)), (5, words(60, 1)), (6, words(60, 1)), (7, words(120_000, 2)), (7, "another text of seven")]


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*names).collect()
    key = lambda rows: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)
    assert key(tuple(r) for r in got) == key(want.fetchall())


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_tables(spark, empty):
    docs = table(spark, AWKWARD)
    if empty:
        docs = docs.limit(0)
    n = docs.count()
    items = spark.createDataFrame([(1, words(60, 1)), (2, None), (None, "x"), (3, "")], "item_id bigint, text string")
    model = langid.train(docs)
    assert langid.identify(docs, model).count() == n
    assert langid.keep_identified(docs, model).columns == docs.columns
    joined = sorted(tuple(r) for r in ngram_join.jaccard_join(docs).collect())
    assert joined == ([] if empty else [*((i, i, 0, 0) for i in (1, 2, 3, 4)), (5, 5, 1, 1), (6, 5, 1, 1), (7, 7, 0, 0), (7, 7, 0, 0)])
    assert ngram_join.deduplicate(docs).count() == (0 if empty else n - 1)
    assert {r.doc_id for r in decontaminate.find_items(docs, items).collect()} == (set() if empty else {5, 6})
    assert decontaminate.decontaminate(docs, items).count() == (0 if empty else n - 3)
    assert substrings.remove_repeats(docs).count() == templates.drop_recurring_lines(docs).count() == n
    mixing.mix(docs).collect()
    assert mixing.mixed(docs).columns == docs.columns
    shards = wavelet.wavelet_shards(docs).collect()
    assert sum(r.n_docs for r in shards) == n


def test_language_is_found_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 and length(text) > 60").select("doc_id", "text", "lang")
    found = held.join(langid.identify(held, model), "doc_id").collect()
    assert np.mean([r.lang == r.lang_found for r in found]) > 0.95
    junk = table(spark, [(1, "xq zzkw qqj vvx jjqk zxw " * 20), (2, "漢字仮名交じり文 " * 30)])
    assert [r.lang_found for r in langid.identify(junk, model).collect()] == ["und", "und"]


def plain_kneser_ney(texts, order):
    """Interpolated Kneser-Ney from its definition: a function to the probability of a symbol after others."""
    seqs = ["\0" * (order - 1) + re.sub(r"[^\w]+|[\d_]+", " ", t.lower()) for t in texts]
    raw = {}
    for s in seqs:
        for i in range(order - 1, len(s)):
            raw[s[i - order + 1 : i + 1]] = raw.get(s[i - order + 1 : i + 1], 0) + 1
    counts = {order: raw}
    for n in range(order - 1, 0, -1):  # in how many longer n-grams each is the end
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def discount(n):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    d = {n: discount(n) for n in counts}

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / langid.ALPHABET
        after = [c for g, c in counts[n].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(counts[n].get(gram, 0) - d[n], 0) / sum(after) + d[n] * len(after) / sum(after) * p(gram[1:])

    return p


def test_models_are_kneser_ney():
    corpora = {"en": ["the cat sat on the mat", "a dog ate the hat", "that is that"], "xx": ["lorem ipsum dolor", "sit amet dolor", "ipsum sit"]}
    models = {k: langid.LanguageModel.train(v, 3) for k, v in corpora.items()}
    whole = langid.Identifier.merge(models)
    whole.complete([t for v in corpora.values() for t in v])
    probes = ["the dog sat", "dolor amet the", "zq", "a", "mat ipsum hat"]
    bits, size = whole.scores(probes)
    for i, x in enumerate(whole.languages):
        p = plain_kneser_ney(corpora[x], 3)
        for j, t in enumerate(probes):
            s = "\0\0" + t
            want = -sum(np.log2(p(s[k - 2 : k + 1])) for k in range(2, len(s))) / len(t)
            assert size[j] == len(t) and abs(bits[j, i] - want) < 1e-6 * want


def test_every_language_is_drawn_at_any_size(spark):
    sizes = {"rare": 1, "some": 500, "main": 10**9, "huge": 10**11, "vast": 10**13}
    below = langid.shares({x: (n, 2**63 // (n + 1)) for x, n in sizes.items()}, 600)
    assert all(abs(n * below[x] / 2**63 - min(n, 600)) <= 1 for x, n in sizes.items())
    assert langid.shares({"x": (10**18, 2**62)}, 600) == {"x": 2**62 + 1}
    docs = table(spark, [(7, words(5, k)) for k in range(3000)]).unionByName(table(spark, [(1, None), (2, "")]))
    rows = langid.sample(docs, 5, 11)  # one id for all: a hash that is almost surely beyond the share
    assert 0 < len(rows) <= 10 and langid.train(docs, sample_docs=5).languages == ["en"]


def similar(texts, threshold=ngram_join.THRESHOLD):
    sets = {i: shingles(t) for i, t in texts}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= threshold}


def joined(texts, pairs):
    """What the join has to say of documents, by their similar pairs."""
    up, links = {i: i for i, _ in texts}, dict.fromkeys((i for i, _ in texts), 0)
    for a, b in sorted(pairs):
        links[a] += 1
        links[b] += 1
        x, y = sorted((up[a], up[b]))
        up = {i: x if r == y else r for i, r in up.items()}
    return {i: (up[i], links[i]) for i in up}


def near_copies():
    r, texts = random.Random(3), []
    for g in range(30):
        base = words(80, 100 + g).split()
        for k in range(4):
            texts.append((g * 4 + k, " ".join(w if r.random() > 0.02 * k else "x" + w for w in base)))
    return texts


def test_jaccard_join_recalls_brute_force(spark, monkeypatch):
    texts = near_copies()
    want = similar(texts)
    members, pairs = ngram_join.class_pairs(table(spark, texts))
    of = {}
    for r in members.collect():
        of.setdefault(r.cls, []).append(r.doc_id)
    got = {tuple(sorted((x, y))) for p in pairs.collect() for x in of[p.a] for y in of[p.b]} | {(x, y) for m in of.values() for x in m for y in m if x < y}
    assert got <= want and len(got) >= 0.9 * len(want)
    docs, known = table(spark, texts), joined(texts, got)
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.jaccard_join(docs).collect()} == known
    monkeypatch.setattr(ngram_join, "small_enough", lambda df, rows=0: df)  # by shuffles, as by broadcasts
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.jaccard_join(docs).collect()} == known
    assert {r.doc_id for r in ngram_join.deduplicate(docs).collect()} == {c for c, _ in known.values()}


def test_large_buckets_are_cut_without_losing_links(spark, monkeypatch):
    """All of 200 near copies fall into common buckets; a chain of revisions and strangers besides."""
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 16)
    base = words(60, 5).split()
    texts = [(i, " ".join([*base, words(2, 1000 + i)])) for i in range(200)]
    texts += [(300 + i, words(40, 77)) for i in range(5)] + [(400 + i, words(40, 2000 + i)) for i in range(20)]
    long = words(400, 8).split()
    texts += [(500 + i, " ".join(long[20 * i : 20 * i + 80])) for i in range(15)]
    want = joined(texts, similar(texts))
    docs = table(spark, texts)
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.jaccard_join(docs, tile_docs=32).collect()} == want
    kept = {r.doc_id for r in ngram_join.deduplicate(docs, tile_docs=32).collect()}
    assert kept == {c for c, _ in want.values()}


def test_twenty_thousand_near_copies_cost_linear_work(spark):
    """No two texts are equal, and all are similar: the pairs that deduplication looks at grow as the texts."""
    base = words(40, 5)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " w"), F.col("id").cast("string")).alias("text"))
    signed = ngram_join._Signed(docs, 3, 32, 3, 64)
    pruning = ngram_join._Pruning(32, 64, ngram_join.THRESHOLD, ngram_join.TOLERANCE)
    assert signed.classes.count() == 20_000
    assert 20_000 <= ngram_join._star_candidates(signed, pruning).count() + 1 <= 32 * 20_000
    assert [r.doc_id for r in ngram_join.deduplicate(docs).collect()] == [0]


def test_groups_across_components_of_a_large_bucket(spark, monkeypatch):
    """Members of a bucket that are far from its smallest class but near to each other still meet."""
    for name, value in (("BUCKET_ROWS", 3), ("FEW", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    long = words(600, 9).split()
    texts = [(i, " ".join(long[6 * i : 6 * i + 100])) for i in range(60)]  # neighbours share most, ends nothing
    kept = {r.doc_id for r in ngram_join.deduplicate(table(spark, texts)).collect()}
    assert kept == {c for c, _ in joined(texts, similar(texts)).values()} == {0}


def test_groups_of_a_long_chain_in_adverse_order(spark):
    order = random.Random(5).sample(range(1, 501), 500)
    chain = [*zip(order, order[1:]), *zip([600, *range(700, 630, -1)], range(700, 630, -1)), (900, 901)]
    pairs = spark.createDataFrame([(min(p), max(p)) for p in chain], "a bigint, b bigint")
    got = {r.id: r.group_id for r in ngram_join.groups(pairs).collect()}
    assert got == {i: 1 for i in range(1, 501)} | {i: 600 for i in (600, *range(631, 701))} | {900: 900, 901: 900}
    assert ngram_join.groups(pairs.limit(0)).count() == 0


def test_spliced_passages_go_as_a_whole(spark):
    passage = words(30, 70) + ". " + words(2, 71) + ". " + words(14, 72)
    plain = words(40, 73)
    host = lambda t, k: f"{words(9, k)} {t} {words(8, k + 1)}."
    texts = [(1, host(passage, 80)), (2, host(passage, 82)), (3, host(plain, 84)), (4, host(plain, 86)), (5, plain), (6, ("la li " * 40).strip())]
    got = {r.doc_id: r.text for r in passages.remove_passages(table(spark, texts)).collect()}
    assert {i: re.sub(r"[\s.]+", " ", got[i]).strip() for i in (2, 4, 5)} == {2: f"{words(9, 82)} {words(8, 83)}", 4: f"{words(9, 86)} {words(8, 87)}", 5: ""}
    assert got[1] == texts[0][1] and got[3] == texts[2][1] and got[6].startswith("la li " * 6) and len(got[6]) < len(texts[5][1])
    assert "op4_passage_dedup" in QUERIES


def test_short_lines_and_sentences_of_copies_go(spark):
    texts = [(1, "All rights reserved\nOne two. Three four. Five."), (2, "All rights reserved\nOne two. Three four. Five."), (3, words(20, 90) + "\nAll rights reserved\nown"), (4, "Isolated here. " + words(8, 91)), (5, "Isolated here. " + words(8, 92))]
    got = {r.doc_id: r.text for r in passages.remove_passages(table(spark, texts)).collect()}
    assert got == {1: texts[0][1], 2: "", 3: words(20, 90) + "\nown", 4: texts[3][1], 5: texts[4][1]}
    assert passages.remove_passages(table(spark, AWKWARD)).count() == len(AWKWARD) and passages.remove_passages(table(spark, AWKWARD).limit(0)).count() == 0


def test_items_are_found_inside_long_texts(spark):
    items = [(i, words(12 + 5 * i, 500 + i)) for i in range(12)]
    texts = [(i, f"{words(8000, i)} {t} {words(8000, 50 + i)}") for i, t in items] + [(99, words(5000, 9999))]
    found = decontaminate.find_items(table(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i, _ in items}


def test_templates_against_a_plain_walk(spark):
    r = random.Random(4)
    texts = [(i, "\n".join(f"user {r.randint(0, 999)} logged in from host{r.randint(0, 9)} after {r.choice(['long', 'short'])} wait" if r.random() < 0.5 else words(9, r.random()) for _ in range(4))) for i in range(20)]
    leaves, place, docs_of = {}, {}, {}
    for i, t in texts:
        for k, line in enumerate(t.split("\n")):
            tok = templates.masked(line)
            mine = leaves.setdefault((len(tok), *tok[: templates.LEADING]), [])
            same = [sum(a == b for a, b in zip(tok, m)) for m in mine]
            best = max(range(len(mine)), key=lambda j: (same[j], -j)) if mine else -1
            if best >= 0 and same[best] >= templates.SIMILARITY * len(tok) - 1e-9:
                mine[best][:] = [a if a == b else None for a, b in zip(mine[best], tok)]
                t_id = id(mine[best])
            else:
                mine.append(list(tok))
                t_id = id(mine[-1])
            place[i, k] = t_id
            docs_of.setdefault(t_id, set()).add(i)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if len(docs_of[place[i, k]]) < templates.MIN_DOCS) for i, t in texts}
    assert {x.doc_id: x.text for x in templates.drop_recurring_lines(table(spark, texts)).collect()} == want


def test_wavelet_shard_access_count_locate(spark):
    docs = table(spark, [(1, "the cat and the dog " * 30), (None, None), (2, "the end"), (2, "the end")])
    enc = tokens.encoding(tokens.vocabulary_bytes())
    for row in wavelet.wavelet_shards(docs.coalesce(1), shard_tokens=50).collect():
        shard = wavelet.WaveletShard(bytes(row.data))
        flat = shard.tokens().tolist()
        assert [shard.access(i) for i in range(len(flat))] == flat
        for t in {*flat, 0}:
            at = [i for i, x in enumerate(flat) if x == t]
            assert shard.count(t) == len(at) and [shard.locate(t, k) for k in range(len(at))] == at
            assert shard.locate(t, len(at)) == -1
        for k, i in enumerate(shard.doc_ids):
            texts = {1: "the cat and the dog " * 30, 2: "the end", None: ""}
            assert shard.document(k) == enc.encode_ordinary(texts[i])


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_wavelet_files_are_read_in_part(spark, tmp_path, scheme):
    docs = table(spark, [(i, words(4000, i) + " the end") for i in range(40)])
    shards = wavelet.wavelet_shards(docs.coalesce(2), shard_tokens=400_000)
    files = wavelet.write_shards(shards, f"{scheme}{tmp_path}/shards/").collect()
    wavelet.write_shards(shards, f"{scheme}{tmp_path}/shards")  # again, onto the same files
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == sorted(f.path.split("/")[-1] for f in files) and len(files) >= 2
    whole = {r.shard_id: bytes(r.data) for r in shards.collect()}
    for f in files:
        local = f.path.removeprefix("file://")
        with open(local, "rb") as file:
            data = file.read()
        assert data == whole[f.shard_id] and len(data) == f.n_bytes
        opened, flat = wavelet.WaveletShard.open(f.path), wavelet.WaveletShard(data).tokens()
        at = np.flatnonzero(flat == flat[len(flat) // 2])
        assert len(flat) == f.n_tokens and opened.access(0) == flat[0]
        assert opened.count(int(flat[at[0]])) == len(at) and opened.locate(int(flat[at[0]]), len(at) - 1) == at[-1]


def test_a_lookup_reads_a_small_part_of_a_file():
    flat = np.random.default_rng(1).integers(0, 50_000, 3_000_000)
    data, read = wavelet.pack(flat, [1, 2], np.array([0, 5, len(flat)]), 16), []

    def part(at, n):
        read.append(n)
        return data[at : at + n]

    shard = wavelet.WaveletShard(part)
    assert [shard.access(i) for i in (0, 1_234_567)] == flat[[0, 1_234_567]].tolist() and sum(read) < 0.25 * len(data)
    where = np.flatnonzero(flat == flat[9])
    assert shard.count(int(flat[9])) == len(where) and shard.locate(int(flat[9]), 3) == where[3] and sum(read) < 0.5 * len(data)


@pytest.mark.parametrize("bits", [7, 64, 100])
@pytest.mark.parametrize("blocks", [(25, 16), (1000, 1000)])
def test_nearest_codes_are_exact(spark, bits, blocks):
    rng = np.random.default_rng(bits)
    vectors = [(i, rng.normal(size=bits).round(2).tolist()) for i in range(60)] + [(60, None), (None, [1.0]), (61, []), (1, [0.0])]
    vectors += [(i, [1.0] * bits) for i in range(70, 100)]  # one code many times
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id bigint, embedding array<double>, place int, code int")
    got = {}
    for r in hamming.nearest(df, k=3, every=2, block_codes=blocks[0], block_queries=blocks[1]).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.distance, r.neighbor_id)
    code = {}
    for i, v in vectors:
        if i is not None and v is not None:
            b = np.zeros(64 * -(-bits // 64), np.uint8)
            b[: len(v)] = np.array(v) > 0
            packed = np.packbits(b, bitorder="little").tobytes()
            code[i] = min(code.get(i, packed), packed)
    dist = lambda a, b: int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
    assert set(got) == {i for i in code if i % 2 == 0}
    for i in got:
        assert [got[i][k] for k in (1, 2, 3)] == sorted((dist(code[i], d), j) for j, d in code.items() if j != i)[:3]


def test_nearest_of_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert hamming.nearest(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (3, [-1.0]), (3, [-1.0])], schema)
    assert [tuple(r) for r in hamming.nearest(two).collect()] == [(0, 3, 1, 1)]


TURNS = "conv_id bigint, turn bigint, role string, text string, path string, pid int, last int"


def check_trees(spark, rows, **options):
    """The packed trees of rows (conv_id, turn, role, text), against each conversation's own turns and a depth-first walk."""
    nodes = chat.prefix_trees(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS), **options).collect()
    enc = tokens.encoding(tokens.vocabulary_bytes())
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, set()).add((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [chat.render(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    assert sorted(c for n in nodes for c in n.conv_ids) == sorted(own)
    full = {n.node_id: n for n in nodes if n.token_ids is not None}
    assert len(full) == sum(n.token_ids is not None for n in nodes) == len({tuple(v[: k + 1]) for v in own.values() for k in range(len(v))})
    for n in nodes:
        path, up = [], n.node_id
        while up:
            path.insert(0, full[up])
            up = full[up].parent_id
        assert n.depth == len(path) - 1 and all(p.tree_id == n.tree_id for p in path)
        if n.attends is not None:
            assert [(a.start, a.end) for a in n.attends] == [(p.start, p.end) for p in path[:-1]]
        for c in n.conv_ids:
            want = [enc.encode_ordinary(t) for t in own[c]]
            assert [p.token_ids for p in path] == want
            assert [x for p in path for x in p.position_ids] == list(range(sum(map(len, want))))
    children = {}
    for n in full.values():
        children.setdefault(n.parent_id, []).append(n)
    for root in children.get(None, []):
        at = place = 0
        todo = [root]
        while todo:
            n = todo.pop()
            assert (n.start, n.end, n.place) == (at, at + len(n.token_ids), place)
            at, place = n.end, place + 1
            todo += sorted(children.get(n.node_id, []), key=lambda x: x.node_id, reverse=True)
    return nodes


def test_chat_trees_share_prefixes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (1, 2, "user", "ok"), (2, 0, "user", "hi"), (2, 1, "bot", "no"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, 0, None, None), (None, 0, "user", "x"), (5, None, "a", ""), (5, 1, "a", words(30_000, 3))]
    assert len(check_trees(spark, rows)) == 7
    assert chat.prefix_trees(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_one_tree_over_many_partitions(spark, monkeypatch, partitions):
    """All conversations begin with one system prompt, and a third of them are equal."""
    monkeypatch.setattr(chat, "CONVERSATIONS_A_ROW", 10)
    r = random.Random(partitions)
    rows = []
    for c in range(120):
        said = ["same", "and same"] if c % 3 == 0 else [r.choice("abc") for _ in range(r.randint(0, 6))]
        rows += [(c, k, "user" if k % 2 else "system", t) for k, t in enumerate(["Be brief.", *said])]
    nodes = check_trees(spark, rows, partitions=partitions)
    assert len({n.tree_id for n in nodes}) == 1 and max(len(n.conv_ids) for n in nodes) <= 10


def test_warc_links_and_damage(spark):
    def record(kind, i, to=(), block=b"GET / HTTP/1.1\r\n\r\n", size=None):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\n" + "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in to)
        return f"{head}Content-Length: {len(block) if size is None else size}\r\n\r\n".encode() + block + b"\r\n\r\n"

    files = [record("request", "q", ["r"]) + record("metadata", "m", ["q"], b"a: b"), record("response", "r", [], b"HTTP/1.1 404 No\r\nA: b\r\n\r\nbody"), record("request", "lone", ["gone"]), b"no warc", None, record("metadata", "bad", [], b"", "x"), record("request", "q", ["r"])]
    df = spark.createDataFrame([(f,) for f in files], "content binary")
    got = {r.capture_id: r for r in warc.assemble(warc.records(df)).collect()}
    assert set(got) == {"r", "lone"} and got["r"].response.status == 404 and bytes(got["r"].response.payload) == b"body"
    assert [x.record_id for x in got["r"].requests] == ["q"] and [x.record_id for x in got["r"].metadata] == ["m"]
    assert got["lone"].response is None
    assert warc.assemble(warc.records(df.limit(0))).count() == 0


def linked(spark, *rows):
    """Captures of records (id, type, links): the ids of what belongs to each."""
    rows = [(i, kind, "u", "2024", list(to), {}, bytearray(b"GET / HTTP/1.1\r\n\r\n"), False, "x", 1) for i, kind, *to in rows]
    df = spark.createDataFrame(rows, warc.RECORD_SCHEMA + ", anchor string, capture_id int")
    return {r.capture_id: {x.record_id for x in [*r.requests, *r.metadata]} for r in warc.assemble(df).collect()}


def test_warc_links_are_followed_to_their_end(spark):
    rows = [("r", "response"), ("d1", "metadata", "r"), ("c2", "metadata", "d1"), ("b3", "request", "c2"), ("a4", "metadata", "b3"), ("s", "response", "x1"), ("x1", "metadata", "gone"), ("y", "metadata", "gone"), ("t", "metadata", "s")]
    assert linked(spark, *rows) == {"r": {"a4", "b3", "c2", "d1"}, "s": {"x1", "t"}, "y": {"y"}}


def test_warc_nearest_response_wins(spark):
    # a direct link beats a smaller id further away; responses pass nothing on; at equal distance the smaller id
    assert linked(spark, ("rA", "response"), ("rB", "response", "rA"), ("qB", "request", "rB")) == {"rA": set(), "rB": {"qB"}}
    near = [("rA", "response"), ("rB", "response"), ("q1", "request", "rA", "m"), ("q2", "request", "rB", "m"), ("m", "metadata"), ("n", "metadata", "q2")]
    assert linked(spark, *near) == {"rA": {"q1", "m"}, "rB": {"q2", "n"}}
    assert linked(spark, ("r", "response"), ("q", "request", "r"), ("m1", "metadata", "q"), ("m2", "metadata", "m1")) == {"r": {"q", "m1", "m2"}}
    assert linked(spark, ("m1", "metadata", "q9"), ("q9", "request"), ("m0", "metadata", "m1"), (None, "request", "q9"), ("z", None)) == {"q9": {"q9", "m1", "m0"}, "z": {"z"}}


def warc_record(i, block, size=None, kind="response"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_warc_gzip_members_behind_damage_are_read(spark, tmp_path):
    long = bytes(random.Random(1).randbytes(300_000)) + b"\nWARC/1.1\r\nno record\r\n\r\n"
    a, b, c, d = (gzip.compress(warc_record(i, x)) for i, x in (("a", b"HTTP/1.1 200 OK\r\n\r\nA"), ("b", long), ("c", b"x"), ("d", b"")))
    broken = b[:5000] + b"\xff" * 50 + b[5050:]
    for name, data in {"whole": a + b + c, "padded": a + b + b"\0\0\0" + c, "junk": a + b + b"junk" + c, "broken": a + broken + c + d, "cut": a + c + b[:100_000]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(data)
        rows = warc.read_warc(spark, str(tmp_path / name)).collect()
        good = {r.record_id: bytes(r.block) for r in rows if r.record_id and not r.truncated}
        damage = [r for r in rows if r.type == "damage"]
        want = {"a": b"HTTP/1.1 200 OK\r\n\r\nA", "b": long, "c": b"x", "d": b""}
        lost = {"broken": {"b"}, "cut": {"b", "d"}}.get(name, {"d"})
        assert good == {k: v for k, v in want.items() if k not in lost}
        assert bool(damage) == (name in ("junk", "broken", "cut"))
        assert {r.record_id for r in rows if r.truncated and r.record_id} <= lost
    (tmp_path / "plain.warc").write_bytes(warc_record("a", long) + warc_record("b", b"abc", 10))
    assert [(r.record_id, len(r.block), r.truncated) for r in warc.read_warc(spark, str(tmp_path / "plain.warc")).collect()] == [("a", len(long), False), ("b", 7, True)]
    assert warc.assemble(warc.read_warc(spark, str(tmp_path / "plain.warc"))).where("truncated").count() == 1


def test_mixing_meets_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 4 else "de", f"src{i % 8}") for i in range(800)], "doc_id bigint, text string, lang string, source string")
    taken = mixing.mix(docs, budget_percent=40).groupBy("domain").sum("taken").collect()
    share = {r[0]: r[1] / 3200 for r in taken}
    assert all(abs(share[d] - w / 10) < 0.01 for d, w in mixing.WEIGHTS["domain"].items())


def test_pipeline_against_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identified_language(spark, docs, SF)
    assert kept.count() >= 0.95 * docs.where("length(text) > 0").count()
    one = corpus_pipeline.one_of_each_group(spark, kept, SF).collect()
    sets = {r.doc_id: shingles(r.text) for r in kept.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= ngram_join.THRESHOLD:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id for r in one} == {root(i) for i in sets}
    bench = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(one, docs.schema), SF)
    clean = {i for i in {r.doc_id for r in one} if not any(len(b & sets[i]) / len(b) >= decontaminate.CONTAINMENT for b in bench if b)}
    assert {r.doc_id for r in left.collect()} == clean
    mixed = corpus_pipeline.mixed_to_weights(spark, left, SF)
    plan = mixing.mix(left).collect()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in plan)
    shards = corpus_pipeline.token_shards(spark, mixed, SF).collect()
    assert sorted(i for s in shards for i in s.doc_ids) == sorted(r.doc_id for r in plan)
    assert json.loads(json.dumps([n for n, _ in corpus_pipeline.STAGES])) == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_shards"]


REMOVERS = {"units": substrings.remove_repeats, "passages": passages.remove_passages, "templates": templates.drop_recurring_lines}


def lines_of_all_kinds():
    shared, other = words(9, 61), words(8, 62)
    texts = [(i, f"{words(7, 300 + i)}\n{shared}\n\n{words(6, 400 + i)}. {other}. {words(5, 500 + i)}\n{shared}") for i in range(1, 9)]
    return [(None, texts[0][1]), (0, None), (0, ""), (-1, "\n\n"), *texts, texts[2], (3, "another text of three\n" + shared), (20, words(60_000, 63) + "\n" + shared)]


@pytest.mark.parametrize("name", sorted(REMOVERS))
def test_removal_keeps_offsets_and_rows(spark, name, monkeypatch):
    texts = lines_of_all_kinds()
    docs = table(spark, texts)
    rows = REMOVERS[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.text, r.removed) for r in by[None]] == [(texts[0][1], [])]
    assert sorted((r.text is None, r.text or "", len(r.removed)) for r in by[0]) == [(False, "", 0), (True, "", 0)]
    assert len(by[3]) == 3 and len({(r.text, str(r.removed)) for r in by[3]}) == 2  # repeated rows are treated alike
    original = {}
    for i, t in texts:
        original.setdefault(i, []).append(t)
    cut = 0
    for r in rows:
        if not r.removed:
            assert r.text in original[r.doc_id]
            continue
        spans = [(x.start, x.end) for x in r.removed]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        cut += len(spans)

        def left(t):
            parts = [t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)])]
            return "".join(parts) if name != "templates" else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {t[:a].count("\n") for a, _ in spans})

        assert r.text in [left(t) for t in original[r.doc_id]]
        if name == "templates":  # whole lines
            assert any(all((t[:a] + "\n")[a - 1 if a else a] == "\n" and (t + "\n")[b] == "\n" for a, b in spans) for t in original[r.doc_id])
    assert cut >= 9
    monkeypatch.setattr({"units": substrings, "passages": passages, "templates": templates}[name], "BROADCAST_ROWS", -1)
    key = lambda found: sorted(map(repr, found))
    assert key(REMOVERS[name](docs).collect()) == key(rows)  # by a shuffle, as by a broadcast


def test_items_in_several_passes(spark):
    items = [(i, words(20, 600 + i)) for i in range(9)]
    docs = table(spark, [(i, f"{words(50, i)} {t}") for i, t in items])
    want = sorted(decontaminate.find_items(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert sorted(decontaminate.find_items(docs, spark.createDataFrame(items, "item_id bigint, text string"), items_a_pass=4).collect()) == want and len(want) == 9


def test_mixing_of_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    plan = mixing.mix(docs, budget_percent=50).collect()
    n = {None: 6, 4: 1, 5: 60, 6: 60}
    for r in plan:
        assert 0 <= r.taken <= r.n_tokens and (r.taken or not r.n_tokens) and (r.doc_id not in n or r.n_tokens == n[r.doc_id])
    total = sum(len((t or "").split()) for _, t in AWKWARD)
    assert abs(sum(r.taken for r in plan) - total / 2) <= 5
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_the_whole_pipeline_on_awkward_tables(spark, tmp_path, empty):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = source.unionByName(table(spark, AWKWARD).select(*source.columns))
    docs = docs.limit(0) if empty else docs
    docs.withColumn("tie", docs["doc_id"]).withColumn("cls", docs["text"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    shards = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [i for s in shards for i in s.doc_ids]
    assert (not ids) if empty else (100 < len(ids) and {i for i in ids if i is not None} <= {r.doc_id for r in docs.collect()})
    assert all(wavelet.WaveletShard(bytes(s.data)).n_tokens == s.n_tokens for s in shards)
