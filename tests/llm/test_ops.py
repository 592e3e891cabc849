import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.oracle import same
from tidelog.llm import boosted_quality, html_extraction, lm_scoring, media, mixing, ngram_join, packing, quality_rules, sharding, suffix_dedup
from tidelog.llm.graph import components
from tidelog.llm.registry import QUERIES


def as_rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, none, folder, name):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert QUERIES[name](spark, folder(documents=none, pages=pages, labels=labels)).count() == 0


@pytest.mark.parametrize("name", ["op2_extendible_sharding", "op4_systematic_mixing"])
def test_sql_on_supplied_rows(spark, sf, name):
    from tidelog.llm.registry import ORACLES

    same(QUERIES[name](spark, sf), ORACLES[name], sf)


# ------------------------------------------------------------------- packing


def test_packing(spark, docs, rows, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    by_text = {}
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
        by_text.setdefault((r[0], len(ids)), []).append(ids)
    out = packing.pack(docs, with_ids=True).toPandas()
    got, seq = Counter(), defaultdict(list)
    for (doc, total, _), part in out.groupby(["doc_id", "doc_tokens", "curve"], dropna=False):
        part = part.sort_values("start")
        times = part.groupby("start").size().iloc[0]  # repeated rows come apart alike or not at all
        if part.length.sum() == total:
            ids = np.concatenate([np.array(x, "<u4") for x in part.ids])
            got[(None if math.isnan(doc) else int(doc), int(total), zlib.crc32(ids.tobytes()))] += 1
        else:
            assert part.length.sum() % total == 0 or times > 1
            ids = by_text[(None if math.isnan(doc) else int(doc), int(total))][0]
            got[(None if math.isnan(doc) else int(doc), int(total), zlib.crc32(ids.tobytes()))] += int(part.length.sum() // total)
    assert got == want
    for r in out.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tok, own, rng = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer()), random.Random(4)
    parts = ["a", "B", "é", "É", "×", "÷", "ß", "İ", "J\u030c", "T\u0308", "≠", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<", ">", "|", ",", ".", "!", "_", "7", "½", "漢", "☃"]
    parts += [" ", " ", "\n", "\t", "\u0085", "\xa0", "\x1c", "\u0301", "Ø", "µ", "ª", "’", "\u212a", "ﬁ", "\x00", "\u1100\u1161"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, "", "word, " * 50_000]
    for a in range(0, len(texts), 500):
        ids, counts, points = own.encode([None if t is None else t.encode() for t in texts[a : a + 500]])
        ends = np.cumsum(counts)
        for t, x, y, point in zip(texts[a : a + 500], ends - counts, ends, points):
            assert ids[x:y].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            assert (point == packing.projection()[packing._slot(ids[x:y])].sum(0)).all()


def test_neighbours_on_the_curve_are_alike(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 400")
    out = packing.tokenized(docs).select("doc_id", "start", "curve", "ids").toPandas().sort_values(["curve", "doc_id", "start"])
    vectors = []
    for _, part in out.groupby(["curve", "doc_id"], sort=False):
        v = np.bincount(np.frombuffer(b"".join(part.ids), np.uint16).astype(np.int64) % 4096, minlength=4096).astype(float)
        vectors.append(v / np.linalg.norm(v))
    v = np.array(vectors)
    near = (v[:-1] * v[1:]).sum(1)
    other = np.random.default_rng(2).permutation(len(v))
    apart = (v * v[other])[other != np.arange(len(v))].sum(1)
    assert np.mean(near) > np.mean(apart) + 0.1


def test_hilbert_curve_steps_by_one():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_keys(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


# ------------------------------------------------------------------ sharding


def test_sharding(spark, docs, rows, folder):
    limit = 5000
    got = sharding.query(spark, folder(documents=docs), limit).collect()
    assert len(got) == len(rows)
    load = defaultdict(lambda: [0, 0])
    for r in got:
        load[r["shard"]][0] += r["n_bytes"]
        load[r["shard"]][1] += 1
    shards = sorted(load)
    assert all(not b.startswith(a) for a, b in zip(shards, shards[1:]))  # leaves of one tree
    for r in got:
        total, n = load[r["shard"]]
        assert (r["shard_bytes"], r["shard_rows"]) == (total, n)
        assert r["fits"] == (total <= limit)
        assert total <= limit or n == 1 or r["depth"] == sharding.BITS
        if r["depth"]:  # the bucket one bit shorter was too large
            assert sum(v[0] for k, v in load.items() if k.startswith(r["shard"][:-1])) > limit


# ------------------------------------------------------------------- quality


def test_statistics_do_not_depend_on_the_batch(rows):
    texts = [(r[1] or "").encode() for r in rows]
    together = boosted_quality.statistics(texts)
    alone = np.concatenate([boosted_quality.statistics([t]) for t in texts])
    assert np.allclose(together, alone)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = boosted_quality.fit(x, y, trees=20, depth=3)
    for row in x[:50]:
        total = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            k = 0
            for _ in range(3):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - 7]
        assert abs(total - forest.margin(row[None])[0]) < 1e-9
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95


def test_quality_held_out_accuracy(spark, sf):
    got = {r["doc_id"]: r for r in boosted_quality.query(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(r["quality"] == got[r["doc_id"]]["predicted"] for r in labels) / len(labels) >= 0.9
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for k, r in got.items())


def test_quality_odd_rows(spark, docs, rows, folder):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = boosted_quality.query(spark, folder(documents=docs, labels=labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)


# -------------------------------------------------------------------- mixing


def test_targets_fill_to_their_stops(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 20), ("c", 5), (None, 7), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights a 1, b 2, c 3, d 1, null 2; c stops at 15, d at 0, the other 27 by weight 1 : 2 : 2
    assert got == pytest.approx({"a": 5.4, "b": 10.8, "c": 15.0, "d": 0.0, None: 10.8})


def test_mixing(spark, docs, rows, folder):
    got = mixing.query(spark, folder(documents=docs))
    frame = got.toPandas()
    assert len(frame) == len(rows)
    by, target = defaultdict(int), {}
    words = defaultdict(int)
    for r in rows:
        words[r[3]] += len(plain.words(r[1]))
    for r in frame.itertuples():
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[r.source_size] += r.taken
        target[r.source_size] = r.target
    for size, t in target.items():
        assert abs(by[size] - t) <= frame["size"].max()
    assert sorted(target) == sorted(words.values())
    docs.repartition(3).write.parquet(folder() + "/again/documents.parquet")  # other files, same mix
    again = mixing.query(spark, folder() + "/again")
    assert as_rows(again, *got.columns) == as_rows(got, *got.columns)


def test_each_source_comes_near_its_target(spark):
    at = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{at}/documents.parquet").select(F.col("doc_id").alias("_d"), "source")
    took = mixing.query(spark, at).join(source, F.col("doc_id") == F.col("_d")).groupBy("source")
    for r in took.agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.median("size").alias("median")).collect():
        assert abs(r["taken"] - r["target"]) <= max(0.01 * r["target"], r["median"])


def test_mix_gives_each_row_as_often_as_it_is_taken(spark, docs, folder):
    taken = mixing.query(spark, folder(documents=docs)).agg(F.sum("taken")).first()[0]
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(plain.words(r["text"])) for r in out.collect()) == taken


# ---------------------------------------------------------------- ngram join


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_ngram_groups(spark, docs, rows, n, percent):
    texts = [r[1] for r in rows]
    roots, sizes = plain.jaccard_groups(texts, n, percent)
    got = ngram_join.label(docs, n, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((r[0], s) for r, s in zip(rows, sizes))
    name, want = {}, {}
    for r in got:
        name.setdefault((r["doc_id"], r["th"]), r["group"])
    groups = defaultdict(Counter)
    for r in got:
        groups[r["group"]][r["doc_id"]] += 1
    for r, root in zip(rows, roots):
        want.setdefault(root, Counter())[r[0]] += 1
    assert sorted(map(sorted, (c.elements() for c in (Counter({str(k): v for k, v in g.items()}) for g in groups.values())))) == sorted(map(sorted, (c.elements() for c in (Counter({str(k): v for k, v in g.items()}) for g in want.values()))))


def test_component_ids_of_the_query(spark, docs, rows, folder):
    roots, sizes = plain.jaccard_groups([r[1] for r in rows], 3, 90)
    least = defaultdict(lambda: None)
    for r, root in zip(rows, roots):
        if r[0] is not None and (least[root] is None or r[0] < least[root]):
            least[root] = r[0]
    want = Counter((r[0], s, r[0] if root is None else least[root]) for r, root, s in zip(rows, roots, sizes))
    assert as_rows(ngram_join.query(spark, folder(documents=docs)), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_keys_meet_wherever_sets_link(percent):
    """Counted, certain and elected keys together: two linked sets share one, whatever the table of common n-grams holds."""
    rng = np.random.default_rng(percent)
    grams = np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
    sets = []
    for _ in range(60):
        base = rng.choice(grams, rng.integers(1, 60), replace=False)
        sets += [np.unique(base), np.unique(np.concatenate([base[len(base) // 30 :], rng.choice(grams, 1)]))]
    for common in (grams[:0], rng.choice(grams, 150, replace=False), grams):
        order = ngram_join.Order(percent, common)
        parts = [order.split(s) for s in sets]
        df = Counter(x for counted, _, _ in parts for x in counted.tolist())
        keys = []
        for counted, sure, spare in parts:
            shared = sorted((x for x in counted.tolist() if df[x] > 1), key=lambda x: (df[x], x))
            keys.append({*sure.tolist(), *shared[: max(0, len(shared) - spare)]})
        linked = 0
        for i, a in enumerate(sets):
            for j in range(i):
                o = len(np.intersect1d(a, sets[j]))
                if 100 * o >= percent * (len(a) + len(sets[j]) - o):
                    linked += 1
                    assert keys[i] & keys[j]
        assert linked > 10


def test_large_blocks_are_cut(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    roots, _ = plain.jaccard_groups([r[1] for r in rows], 3, 60)
    got = ngram_join.label(docs, 3, 60).collect()
    assert len({r["group"] for r in got if r["group"] is not None}) == len({x for x in roots if x is not None})


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(1)
    for percent in (50, 80, 90):
        base = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(12)]
        sets = [np.unique(np.concatenate([b, rng.integers(0, 60, 2)])).astype(np.uint64) for b in base for _ in range(6)]
        tree = ngram_join.PrefixTree([s.astype(np.int64) for s in sets])
        for q in sets:
            inside = np.zeros(60, bool)
            inside[q.astype(int)] = True
            want = {k for k, s in enumerate(sets) if 100 * len(set(q) & set(s)) >= percent * len(set(q) | set(s))}
            assert set(tree.similar(q.astype(np.int64), inside, percent)) == want


def test_keep_one_of_each_group(spark, docs, rows):
    roots, _ = plain.jaccard_groups([r[1] for r in rows], 3, 90)
    kept = ngram_join.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    empty = sum(x is None for x in roots)
    assert kept.count() == len({x for x in roots if x is not None}) + empty


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 200: 100, 150: 100, **{300 + k: 300 for k in range(1, 30)}}


# -------------------------------------------------------------- suffix dedup


def test_difference_cover():
    for q in (2, 3, 5, 7, 13):
        v, cover = suffix_dedup.difference_cover(q)
        assert v == q * q + q + 1 and len(cover) == q + 1
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_repeated_passages(spark, docs, rows, folder):
    want = Counter()
    for r, (raw, mask) in zip(rows, plain.repeated([r[1] for r in rows], 400)):
        left = bytes(b for b, m in zip(raw, mask) if not m)
        runs = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        want[(r[0], len(raw), sum(mask), runs, hashlib.sha256(left).hexdigest())] += 1
    got = suffix_dedup.query(spark, folder(documents=docs))
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    for r in got.filter("not changed").collect() + got.filter("changed").collect():
        assert r["changed"] == (r["n_removed"] > 0) and r["n_kept"] == r["n_bytes"] - r["n_removed"]
        assert r["changed"] or hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    assert sum(k[2] > 0 for k in want) > 10


def test_remove_repeats_keeps_columns(spark, docs):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in out.collect())


def _left_without_passages(texts):
    """Bytes left once repeated strings of 400 bytes and of 51 words are gone."""
    at = [[m.span() for m in plain.WORD.finditer(t or "")] for t in texts]
    grams = [[tuple(t[a:b] for a, b in w[k : k + 51]) for k in range(len(w) - 50)] for t, w in zip(texts, at)]
    seen = Counter(g for x in grams for g in x)
    for t, w, x, (raw, mask) in zip(texts, at, grams, plain.repeated(texts, 400)):
        mask = bytearray(mask)
        gone = [(len(t[: w[k][0]].encode()), len(t[: w[k + 50][1]].encode())) for k, g in enumerate(x) if seen[g] > 1]
        for a, b in gone:
            mask[a:b] = b"\1" * (b - a)
        yield bytes(b for b, m in zip(raw, mask) if not m)


def test_passages_of_over_fifty_words(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    short, fifty, many = some(51), some(50), some(60)
    assert max(len(x.encode()) for x in (short, fifty, many)) < 400
    texts = [f"{some(30)} {short} {some(20)}", f"{short.replace(' ', chr(10))} {some(9)}", f"{some(9)} {fifty} {some(9)}", f"{some(9)} {fifty}"]
    texts += [f"{some(40)}\n{many}\n{some(40)}" for _ in range(12)] + [f"{many} {some(3)} {many}", f"x{many}", "b " * 60, "漢 " * 55 + short, short, short[:-1], some(3000), None, ""]
    texts += [f"{some(5)} {some(70)}"] * 2
    want = Counter((k, len(left), left.decode()) for k, left in enumerate(_left_without_passages(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = suffix_dedup.query(spark, folder(documents=docs))
    assert as_rows(got, "doc_id", "n_left", "text_left") == want
    out = suffix_dedup.remove_repeats(docs, passages=True)
    assert as_rows(out, "doc_id", "text") == Counter((k, left if texts[k] is not None else None) for k, n, left in want if left.strip() or not texts[k])
    assert got.filter("doc_id = 0").first()["n_removed"] == 0 and (0, len(texts[0].encode()) - len(short.encode()), texts[0].replace(short, "")) in want
    assert any(k == 2 and left == texts[2] for k, _, left in want)


def test_passages_of_the_supplied_rows(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = Counter((k, left.decode("utf-8", "ignore")) for k, left in zip(texts, _left_without_passages(list(texts.values()))))
    got = suffix_dedup.query(spark, sf)
    assert as_rows(got, "doc_id", "text_left") == want
    assert got.filter("n_left < n_kept").count() > 10


# ------------------------------------------------------------- quality rules


def test_quality_rules(spark, docs, rows, folder):
    got = quality_rules.query(spark, folder(documents=docs))
    want = Counter((r[0], *plain.base_counts(r[1])) for r in rows)
    assert as_rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()


def test_quality_rules_reject_noise_and_keep_prose(spark, sf):
    got = {r["doc_id"]: r for r in quality_rules.query(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    assert all(r["kept"] for r in good if not r["base_failed"])


# --------------------------------------------------------------------- media


def _crc(data, table, width):
    crc = 0
    for x in data:
        crc = (crc << 8 & ((1 << width) - 1)) ^ table[crc >> (width - 8) ^ x]
    return crc


def _flac_file(blocks, total=None):
    """Frames of one constant 8-bit channel, 192 samples each."""
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44 | 7 << 36 | (192 * blocks if total is None else total)).to_bytes(8, "big")) + bytes(16)
    out = b"fLaC\x80" + (34).to_bytes(3, "big") + info
    for k in range(blocks):
        head = bytes([0xFF, 0xF8, 0x14, 0x02, k])
        frame = head + bytes([_crc(head, media.CRC8, 8)]) + bytes([0, 40 + k])
        out += frame + _crc(frame, media.CRC16, 16).to_bytes(2, "big")
    return out


def test_media_lengths_are_exact():
    """What follows a file does not belong to it; what only looks like its end does not end it."""
    import io
    import zipfile

    def lengths(raw):
        return [(at, n, media.FORMATS[k][0]) for at, n, k in media.Sniffer().files(raw)]

    flac = _flac_file(5)
    assert lengths(flac) == [(0, len(flac), "flac")] and lengths(b"ab" + flac + b"tail" * 9) == [(2, len(flac), "flac")]
    assert lengths(flac[:-1]) == [] and lengths(_flac_file(5, total=5000)) == []
    assert lengths(_flac_file(3, total=0)) == [(0, len(_flac_file(3)), "flac")]

    def pdf(revisions):
        out = b"%PDF-1.4\n1 0 obj <<>> endobj\n"
        for _ in range(revisions):
            at = len(out)
            out += b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF" % at
        return out

    assert lengths(pdf(3) + b" and text") == [(0, len(pdf(3)), "pdf")]
    assert lengths(b"--" + pdf(2) + pdf(1) + b"!") == [(2, len(pdf(2)), "pdf"), (2 + len(pdf(2)), len(pdf(1)), "pdf")]

    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as f:
        f.writestr("a", "hello")
    with zipfile.ZipFile(outer, "w") as f:
        f.writestr("in.zip", inner.getvalue())  # stored: its end record comes first
        f.comment = b"PK\x05\x06"
    z = outer.getvalue()
    got = lengths(b"x" + z + b"y" * 30)
    assert (1, len(z), "zip") in got and (1 + z.index(inner.getvalue()), len(inner.getvalue()), "zip") in got and len(got) == 2

    def page(kind, serial, body):
        return b"OggS\0" + bytes([kind]) + bytes(8) + bytes([serial]) * 4 + bytes(8) + b"\x01" + bytes([len(body)]) + body

    two = page(2, 1, b"a") + page(2, 2, b"b") + page(4, 1, b"c") + page(4, 2, b"d")
    assert lengths(two + b"OggS")[0] == (0, len(two), "ogg")
    assert media.Sniffer().sniff(two + b"..", "audio/ogg")[2] == []  # pages within belong to the file


def test_media_many_beginnings_take_one_pass():
    import time

    raw = (b"%PDF-" + b"PK\x03\x04") * 40_000 + b"PK\x05\x06" * 1000
    start = time.time()
    assert list(media.Sniffer().files(raw)) == []
    assert time.time() - start < 20


def test_media_payload(spark, docs, rows, folder):
    got = media.query(spark, folder(documents=docs)).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        want[(r[0], len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(r["feature"].startswith("type=audio/wav;") for r in got)


def _samples():
    import gzip
    import io
    import struct
    import zipfile

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
    bmp = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"\x12\xff\x00\x34\xff\xd9"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "hello")
    return {"png": png, "gif": gif, "bmp": bmp, "jpeg": jpeg, "wav": media.to_wav(b"abcd"), "pdf": b"%PDF-1.4 ... startxref 9 %%EOF", "zip": z.getvalue(), "gzip": gzip.compress(b"hi" * 50), "ogg": b"OggS\0\4" + bytes(20) + b"\x01\x03abc"}


def test_sniffing_and_carving(spark):
    s = media.Sniffer()
    types = {n: t for n, t, _, _ in media.FORMATS}
    for name, raw in _samples().items():
        assert s.sniff(raw, "text/plain")[:2] == (types[name], True), name
        assert s.sniff(b"some text " + raw + b" more", "text/plain") == ("text/plain", False, [(10, len(raw), name)]), name
        assert s.sniff(raw[:-3], "image/webp")[0] == "application/octet-stream" or name in ("pdf",)
    df = spark.createDataFrame([(b"x" + _samples()["png"], "image/png", 1), (None, None, 2)], "m binary, declared string, at int")
    got = media.inspect_column(df, "m", "declared").orderBy("at").collect()
    assert got[0]["true_type"] == "application/octet-stream" and got[0]["embedded"][0]["bytes"] == _samples()["png"]
    assert got[1]["embedded"] == []


# ---------------------------------------------------------------------- html


def page(n, body=""):
    return f"<html><head><title>t</title><script>if (a < b) x('</p>')</script></head><body><div class=top><a href=/>Home</a> Our site</div><div id=main><h1>Head {n}</h1><p>Body &amp; text {n}&nbsp;here<p>Second <b>bo</b>ld {n}{body}</div><div class=end>All rights reserved</div></body></html>"


def test_wrapper_removes_what_is_constant(spark):
    rows = [(k, "http://Host.example/a", page(k)) for k in range(8)] + [(100, "http://other.example", page(100)), (101, None, None), (102, "x", "<p>un<closed &lt; <!-- c"), (103, "http://host.example/z", page(3))]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got[3]["text"] == "Head 3 Body & text 3 here Second bold 3"
    assert got[3]["n_chars"] == len(got[3]["text"])
    assert got[103]["text"] == got[3]["text"]
    assert got[100]["text"].startswith("Home Our site Head 100")  # one page shows no template
    assert (got[101]["text"], got[101]["url"]) == ("", None)
    assert len(got) == len(rows)


def test_markup_says_what_is_not_text(spark):
    inner = '<header><h1>T</h1></header><p>Keep</p><aside>no</aside><form>no<input></form><div class="share-buttons">no</div><div hidden>no</div><section id="comments"><p>no</p></section><div class="ad">no</div><ul><li>one<li>two</ul>'
    raw = f"<body><nav>no</nav><header>no</header><div class='cookie-notice'>no</div><article>{inner}</article><footer>no</footer>"
    one = spark.createDataFrame([(1, "http://a.b", raw)], "page_id long, url string, html string")
    assert html_extraction.extract(one).first()["text"] == "T Keep one two"


def test_supplied_pages(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extraction.query(spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())


def test_parser_never_fails():
    for raw in ("<" * 50, "<a" * 50, "<div>" * 3000, "<p><b></p></b></div>", "<script>", "<!--", '<a title="', "&#xD800; &bad; &#99999999;", "<li>" * 500):
        html_extraction.main_text(html_extraction.parse(raw), None)


# ------------------------------------------------------------------ LM score


def test_lm_base_scores(spark, docs, rows, folder):
    count, tokens = Counter(), []
    for r in rows:
        w = plain.words(plain.lower(r[1])) + [None]
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0
        tokens.append((r[0], held, w))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, held, w in tokens)
    got = lm_scoring.query(spark, folder(documents=docs)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_log_bloom_errs_upwards_only():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64)
    counts = rng.integers(1, 3000, 4000)
    levels = lm_scoring.level_of(counts)
    bits = np.zeros(lm_scoring.FILTER_BYTES, np.uint8).reshape(lm_scoring.SEGMENTS, -1)
    for s in np.unique(lm_scoring.segment_of(keys)):
        one = np.zeros(1 << lm_scoring.SEGMENT_BITS, bool)
        mine = lm_scoring.segment_of(keys) == s
        lm_scoring.insert(one, keys[mine], levels[mine])
        bits[int(s)] = np.packbits(one)
    bloom = lm_scoring.LogBloom(bits.ravel())
    read = bloom.levels(keys)
    assert (read >= levels).all() and (read == levels).mean() > 0.99
    assert (bloom.levels(rng.integers(0, 2**63, 4000).astype(np.uint64)) == 0).mean() > 0.99
    value = lm_scoring.value_of(levels)
    assert (np.abs(np.log2(value / counts)) <= 0.5).all()


def test_lm_filter_grows_with_its_insertions(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SEGMENT_BITS", 12)  # 64 such segments are 32,768 insertions at 8 bits
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**56, 40_000).astype(np.uint64))
    levels = lm_scoring.level_of(rng.integers(1, 30, len(keys)))
    bloom = lm_scoring.LogBloom.of(keys, levels, 8)
    assert bloom.segments > lm_scoring.SEGMENTS
    read = bloom.levels(keys)
    assert (read >= levels).all() and (read == levels).mean() > 0.95
    assert lm_scoring.buckets_for(30 << 31) > lm_scoring.buckets_for(1 << 31) > lm_scoring.buckets_for(0)


def test_lm_scores_equal_a_plain_model(spark, docs, rows, folder):
    docs_, words, pairs = [], Counter(), Counter()
    for r in rows:
        w = plain.words(plain.lower(r[1])) + [None]
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0
        docs_.append((str(r[0]), w))
        if not held:
            words.update(w)
            pairs.update(zip(["start", *((x,) for x in w)], w))
    starts = sum(n for (a, _), n in pairs.items() if a == "start")
    total, distinct = sum(words.values()), len(words)

    def value(n):
        return float(lm_scoring.value_of(lm_scoring.level_of(np.array([n])))[0]) if n else 0.0

    want = []
    for name, w in docs_:
        at, score = "start", 0.0
        for x in w:
            ctx = starts if at == "start" else value(words[at[0]])
            uni = (value(words[x]) + lm_scoring.ALPHA) / (total + lm_scoring.ALPHA * (distinct + 1))
            score += math.log10((min(value(pairs[at, x]), ctx) + lm_scoring.MU * uni) / (ctx + lm_scoring.MU))
            at = (x,)
        want.append((name, round(score, 4)))
    got = [(str(r["doc_id"]), round(r["score"], 4)) for r in lm_scoring.query(spark, folder(documents=docs)).collect()]
    assert sum((Counter(want) - Counter(got)).values()) <= len(want) // 20  # the filter may err upwards


def test_lm_filter_charges_every_level(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SEGMENT_BITS", 15)
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 20_000, np.uint64))
    levels = np.full(len(keys), 21)  # far more insertions than keys
    bloom = lm_scoring.LogBloom.of(keys, levels)
    assert len(bloom.packed) * 8 >= lm_scoring.BITS_EACH * levels.sum()
    assert np.unpackbits(bloom.packed).mean() < 0.41  # 1 - exp(-4 hashes / 8 bits)
    assert (bloom.levels(rng.integers(0, 2**64, 20_000, np.uint64)) > 0).mean() < 0.035
    assert (bloom.levels(keys) == 21).mean() > 0.96


def induced(pages):
    first, *others = (html_extraction.HostWrapper.of(html_extraction.parse(x)) for x in pages)
    for x in others:
        first.add(x)
    return first


@pytest.mark.parametrize("deep", [100, 3000])
def test_deep_nesting_keeps_the_text_after_it(deep):
    rows = [f"<div id=wrap><article>{'<div>' * deep}<p>inner {k}</p>{'</div>' * deep}<p>after {k}</p><div class=comments>{'<div>' * deep}x{'</div>' * deep}no {k}</div></article></div>" for k in range(6)]
    parsed = [html_extraction.parse(x) for x in rows]
    w = induced(rows)
    w = html_extraction.HostWrapper.loads(w.finish().dumps())
    assert [html_extraction.main_text(x, w) for x in parsed] == [f"inner {k} after {k}" for k in range(6)]


def test_alignment_is_simple_tree_matching(monkeypatch):
    tree = lambda x: html_extraction.tree_of(html_extraction.parse(x)).kids
    nav, main, advert = "<div><a>x</a><a>y</a><a>z</a></div>", "<div><p>a</p><p>b<b>c</b></p></div>", "<div><img></div>"
    assert html_extraction.pairs_of(tree(nav + main), tree(advert + nav + main)) == [(0, 1), (1, 2)]
    assert html_extraction.pairs_of(tree(nav + main + "<div><p>a</p></div>"), tree(advert + nav + "<div><p>a</p><p>c</p><p>d</p></div>")) == [(0, 1), (1, 2)]
    long = [f"<{'h2' if k % 3 else 'p'}>{k}</{'h2' if k % 3 else 'p'}>" for k in range(700)]
    a, b = tree("<i>1</i>" + "".join(long) + "<i>2</i>"), tree("<u>1</u>" + "".join(long[:400] + ["<ul></ul>"] + long[400:]) + "<u>2</u>")
    want = [(1 + k, 1 + k + (k >= 400)) for k in range(700)]
    assert html_extraction.pairs_of(a, b) == want
    monkeypatch.setattr(html_extraction, "WHOLE_CELLS", 1000)
    assert html_extraction.pairs_of(a, b) == want


def test_template_is_found_late_by_layout_and_from_two_pages():
    def texts(pages, ask, parts=1):
        step = -(-len(pages) // parts)
        first, *others = (html_extraction.HostWrapper.loads(induced(pages[k : k + step]).dumps()) for k in range(0, len(pages), step))
        for x in others:
            first.add(x)
        w = html_extraction.HostWrapper.loads(first.finish().dumps())
        return [html_extraction.main_text(html_extraction.parse(x), w) for x in ask]

    old = [f"<body><div class=a><p>Menu</p></div><p>old {k}</p></body>" for k in range(4000)]
    new = [f"<body><div class=a><p>Menu</p></div><p>new {k}</p><div class=b><p>Late line</p></div></body>" for k in range(2000)]
    for parts in (1, 3):
        assert texts(old + new, [old[3], new[-1]], parts) == ["old 3", "new 1999"]
    three = [f"<body><div class=x{k % 3}><div class=y{k % 3}><p>Menu {k % 3}</p></div><div class=z{k % 3}><p>text {k}</p></div></div></body>" for k in range(30)]
    assert texts(three, three) == [f"text {k}" for k in range(30)]
    two = [f"<body><div><p>Menu</p></div><p>text {k}</p></body>" for k in range(2)]
    assert texts(two, two) == ["text 0", "text 1"]
    assert texts(two[:1] * 5, two[:1]) == ["Menu text 0"]  # one page, however often


def test_the_wrapper_decides_inside_and_outside_of_articles():
    def make(k, body, stamp=""):
        return f"<body><div class=top><p>Menu</p><p>Teaser {stamp or k}</p></div><article><h1>Title {k}</h1><p>{body}</p><p>Join our <a href=x>list</a></p><span>Follow us</span></article><div class=end><p>All rights</p></div></body>"

    pages = [make(k, f"story {k}") for k in range(6)] + [make(9, "copied story", f"t{k}") for k in range(20)]
    w = html_extraction.HostWrapper.loads(induced(pages).finish().dumps())
    got = [html_extraction.main_text(html_extraction.parse(x), w) for x in pages]
    assert got[2] == "Teaser 2 Title 2 story 2"
    assert got[10] == "Teaser t4 Title 9 copied story"  # 20 of 26 pages, but one article


def test_compression_judges_every_byte_and_other_alphabets(spark, sf):
    import zstandard

    packer, bands = zstandard.ZstdCompressor(level=3), quality_rules.Bands()
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1}
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["doc_id"] in good and r["lang"] == "en" and len(r["text"] or "") > 400]
    assert texts
    for first in (0x430, 0x3B1, 0x915):  # Cyrillic, Greek, Devanagari
        table = {ord("a") + k: first + k for k in range(26)} | {ord("A") + k: first + k - (32 if first == 0x430 else 0) for k in range(26)}
        for t in texts:
            assert quality_rules.compression(t.translate(table).encode(), bands, packer)[3] == quality_rules.compression(t.encode(), bands, packer)[3]
    prose = " ".join(texts).encode()
    assert quality_rules.compression(prose[:4095], bands, packer)[2] == 0
    noise = bytes(np.random.default_rng(1).integers(0, 128, 2047, np.uint8))
    assert quality_rules.compression(prose[:2048] + noise, bands, packer)[1:3] == (2, 1)
    assert not quality_rules.compression(b"spam " * 25, bands, packer)[3]
