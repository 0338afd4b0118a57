"""Operators on texts against plain models."""

import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nodeflow.llm import decontaminate, langid, linededup, packing, simhash, tokencounts
from tests.llm.common import empty, tricky, tricky_rows

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_token_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(BYTES)
    for block in (50, 32_000_000):
        got = tokencounts.token_counts(tricky(spark), BYTES, block_chars=block).collect()
        assert len(got) == len(tricky_rows())
        for r in got:
            assert r["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
            assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 512)
    assert tokencounts.token_counts(empty(spark), BYTES).count() == 0


def test_pre_tokens_around_every_character():
    import regex

    tok, pattern = Tokenizer.from_file(BYTES), regex.compile(tokencounts.PRE_TOKEN)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in [*range(0x3000), *range(0xFE00, 0xFFF0)] if not 0xD800 <= c < 0xE000]
    got = tokencounts.block_counts(texts, tok, pattern, None)
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def _fingerprint(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _reach(nodes, linked):
    out, left = {}, set(nodes)
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            new = {y for y in left if linked(x, y)}
            left -= new
            group |= new
            todo += new
        out |= dict.fromkeys(group, frozenset(group))
    return out


def test_simhash_equals_all_pairs(spark, sf):
    rows = [(r[0], r[1]) for r in tricky_rows()] + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fps = {t: _fingerprint(t) for _, t in rows}
    groups = _reach(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {g: min((i for i, t in rows if i is not None and fps[t] in g), default=None) for g in set(groups.values())}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = simhash.near_duplicates(df).select("doc_id", simhash.as_hex(F.col("fp")).alias("f"), "component_id").collect()
    want = Counter((i, f"{fps[t]:016x}", least[groups[fps[t]]]) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    kept = simhash.keep_one(tricky(spark))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    own = _reach({_fingerprint(r[1]) for r in tricky_rows()}, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(ids) == len(set(ids)) == len(set(own.values()))
    assert kept.columns == tricky(spark).columns and simhash.near_duplicates(empty(spark)).count() == 0


def test_bucket_links_connect_in_tiles():
    rng = np.random.default_rng(0)
    fps = np.unique(np.uint64(0xABCD) << np.uint64(32) | rng.integers(0, 1 << 9, 300, np.uint64))
    links = simhash.bucket_links(fps, np.ones(len(fps), bool), 3, tile=7)
    assert len(links) < len(fps)
    groups = _reach(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    joined = _reach(fps.tolist(), lambda a, b: (a, b) in links or (b, a) in links)
    assert set(groups.values()) == set(joined.values())


def test_line_dedup_equals_exact_counts(spark):
    rows = tricky_rows()
    boiler, near, blank = "All rights reserved.", "Almost everywhere.", "  "
    for k in range(40):
        lines = ["own line %d" % k, boiler, blank, near if k < 36 and k % 12 < 9 else "x", boiler, ""]
        rows.append((500 + k, "\n".join(lines), "en", f"s{k % 12}", 1, 1, "b", 5, "s", "x"))
    sites = {}
    for r in rows:
        for line in (r[1] or "").split("\n") if r[1] is not None else []:
            if line.strip(" "):
                sites.setdefault(line, set()).add(r[3])
    common = {x for x, s in sites.items() if len(s - {None}) >= 10}
    assert boiler in common and near not in common
    want = Counter()
    for r in rows:
        lines = [] if r[1] is None else r[1].split("\n")
        stay = [x for x in lines if x not in common]
        want[(r[0], None if r[1] is None else "\n".join(stay), len(lines), len(lines) - len(stay))] += 1
    for band in (0.15, 5.0):  # all decided exactly with the wide band
        got = linededup.drop_boilerplate(tricky(spark, rows), linededup.LineParams(band=band)).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert Counter(tuple(r) for r in got) == want
    assert linededup.drop_boilerplate(empty(spark)).count() == 0


def _normal(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_decontamination_equals_all_windows(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:8] + [(900, "one two"), (901, None), (902, " "), (None, "three four five six seven eight")]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(25).collect()]
    a, b = _normal(items[0][1]), _normal(items[1][1])
    docs += [(800, "x y " + " ".join(a) + " z"), (801, " ".join(a[1:]) + " end"), (802, " ".join(a[:10] + ["new"] + a[11:])), (803, " ".join(b[: len(b) // 2])),
             (804, "ONE, two"), (805, "one"), (806, None), (807, ""), (None, " ".join(b)), (808, "so three four five six seven eight " * 3), (808, "so three four five six seven eight " * 3)]
    want = set()
    for d, t in docs:
        w = _normal(t)
        for i, x in items:
            v = _normal(x)
            width = min(5, len(v))
            grams = lambda q: Counter(tuple(q[k : k + width]) for k in range(len(q) - width + 1))
            best = [(-sum((grams(w[s : s + len(v)]) & grams(v)).values()) / sum((grams(w[s : s + len(v)]) | grams(v)).values()), s) for s in range(len(w) - len(v) + 1)] if v else []
            if best and -min(best)[0] >= 0.8:
                want.add((d, i, min(best)[1], -min(best)[0]))
    left, right = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("x")), spark.createDataFrame(items, "item_id long, text string")
    for bound in (0, 10**6):
        got = decontaminate.matches(left, right, decontaminate.DecontaminationParams(broadcast_shingles=bound)).select("doc_id", "item_id", "start", "similarity").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    bad = {d for d, *_ in want}
    assert {r["doc_id"] for r in decontaminate.clean(left, right).collect()} == {d for d, _ in docs} - bad
    assert decontaminate.matches(empty(spark), right).count() == 0 and decontaminate.matches(left, right.limit(0)).count() == 0
    assert decontaminate.clean(tricky(spark), right.limit(0)).count() == len(tricky_rows())


def test_decontamination_of_documents_shorter_than_the_item(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(4).collect()] + [(900, "one two three four five six"), (901, "red " * 12)]
    docs = [(100 * k + cut, " ".join(_normal(x)[lead : len(_normal(x)) - cut])) for k, (_, x) in enumerate(items) for lead in (0, 1) for cut in range(1, 9)]
    docs += [(2000, "one two three four"), (2001, "red " * 10), (2002, "red " * 11), (2003, "one")]
    want = set()
    for d, t in docs:
        w = _normal(t)
        for i, x in items:
            v = _normal(x)
            grams = lambda q: Counter(tuple(q[k : k + 5]) for k in range(len(q) - 4))
            best = []
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s : s + len(v)]), grams(v)
                best.append((-sum((a & b).values()) / sum((a | b).values()), s))
            if -min(best)[0] >= 0.8:
                want.add((d, i, min(best)[1], -min(best)[0]))
    assert {(1, items[0][0]), (2002, 901)} <= {(d, i) for d, i, *_ in want} and not {2000, 2001, 2003} & {d for d, *_ in want}
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.select("doc_id", "item_id", "start", "similarity").collect()} == want


def test_every_fingerprint_in_the_radius_shares_an_entry():
    rng = np.random.default_rng(3)
    for _ in range(200):
        flips = rng.choice(64, decontaminate.RADIUS, replace=False)
        assert min(np.bincount(flips // decontaminate.BLOCK_BITS, minlength=decontaminate.BLOCKS)) <= decontaminate.BALL


def test_decontamination_finds_similar_windows_with_distant_fingerprints(spark, sf):
    bits = lambda w: sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in w) > len(w))
    rng, docs, items, want = np.random.default_rng(7), [], [], set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        v = _normal(r["text"])
        k = (len(v) - 4) // 10  # replaced words at one end, within similarity 0.8
        items.append((r["item_id"], r["text"]))
        for _ in range(60):
            w = v[: len(v) - k] + [f"w{x}" for x in rng.integers(0, 10**6, k)]
            grams = lambda q: Counter(tuple(q[i : i + 5]) for i in range(len(q) - 4))
            if sum((grams(w) & grams(v)).values()) / sum((grams(w) | grams(v)).values()) >= 0.8 and (bits(w) ^ bits(v)).bit_count() > 11:
                want.add((len(docs), r["item_id"]))
                docs.append((len(docs), " ".join(w)))
    assert len(want) >= 5
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert want <= {tuple(r) for r in got.select("doc_id", "item_id").collect()}


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    judged = langid.predict(docs.withColumn("score", F.lit("clash")), model)
    held = judged.where(out & F.col("lang").isNotNull())
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert judged.count() == docs.count() and judged.where("score < 0 or score > 1 or rejected").count() == 0
    got = langid.predict(tricky(spark), model).collect()
    assert len(got) == len(tricky_rows())
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in got)
    junk = spark.createDataFrame([("ⵣⵣⵣ ⴰⴱⴳ ⵥⵥⵥⵥ",)], "text string")
    assert langid.predict(junk, model).first()["rejected"]
    none = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(tricky(spark), none).collect()} == {"und"} and langid.predict(empty(spark), model).count() == 0


def test_unlearned_languages_and_random_letters_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{os.path.dirname(sf)}/sf0.1/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rng = np.random.default_rng(4)
    word = lambda n, letters: "".join(rng.choice(list(letters), n))
    strangers = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        word(300, "abcdefghijklmnopqrstuvwxyz"), " ".join(word(n, "abcdefghijklmnopqrstuvwxyz") for n in rng.integers(2, 10, 60)), word(300, "0123456789abcdef")]
    got = langid.predict(spark.createDataFrame([(x,) for x in strangers], "text string"), model)
    assert [r["text"][:20] for r in got.where("NOT rejected").collect()] == []
    clean = langid.predict(docs.where(langid.held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")), model)
    assert clean.where("rejected").count() <= 0.001 * clean.count() and clean.count() > 2000


def test_languages_of_many_copies_are_learned(spark):
    rows = spark.range(4 * 4000).select((F.col("id") % 4).alias("k"), F.floor(F.col("id") / 4).alias("n"))
    number = F.when(F.col("k") == 3, F.col("n") % 5).otherwise(F.col("n"))  # 800 copies of each text of the last language
    word = F.translate(F.concat_ws(" ", *[F.substring(F.md5(F.concat_ws("-", "k", number, F.lit(j))), 1, 6) for j in range(9)]), "0123456789", "ghijklmnop")
    docs = rows.select(F.when(F.col("k") == 3, F.translate(word, "abcdefghijklmnop", "αβγδεζηθικλμνξοπ")).otherwise(word).alias("text"), F.concat(F.lit("l"), "k").alias("lang"))
    alone = spark.createDataFrame([("слово", "l4"), ("123", "l4"), ("456", "l5")], "text string, lang string")
    model = langid.fit(docs.unionByName(alone), langid.LanguageParams(sample_rows=100))
    assert set(model.labels) == {"l0", "l1", "l2", "l3", "l4"}
    judged = langid.predict(docs.where("lang = 'l3'"), model)
    assert judged.where("lang_pred = lang").count() == 4000


def test_language_model_stays_sparse():
    import tracemalloc

    params, rng, rows = langid.LanguageParams(), np.random.default_rng(2), []
    assert params.sample_rows == 4000 and params.dims == 8192
    for k in range(params.sample_rows):
        at = np.unique(rng.integers(2000 * (k % 3), 2000 * (k % 3) + 2000, 100)).astype("<u4")
        rows.append(("en", at.tobytes(), np.ones(len(at), "<f4").tobytes()))
    tracemalloc.start()
    model = langid._learn(rows, params)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < params.sample_rows * params.dims * 4 / 4  # bytes; the dense rows alone are four times that
    found = {tuple(np.unique(np.flatnonzero(c) // 2000)) for c in model.centroids}
    assert found == {(0,), (1,), (2,)} and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)


def test_ngrams_do_not_depend_on_pieces():
    text, letters = "Zwölf Boxkämpfer 𝔞𝔟 jagen 12 Viktor\nquer ☃ über den Sylter Deich " * 9, langid._letters()
    whole = langid.ngram_counts(text, letters, (1, 2, 3), 512)
    for step in (3, 7, 64, len(text)):
        assert (langid.ngram_counts(text, letters, (1, 2, 3), 512, step) == whole).all()


def _padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        counts = rng.integers(1, 9, len(lengths))
        every = np.repeat(lengths, counts)
        for k in (1, 2, 3, 4):
            best = min(_padding(every, [*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1], n))
            got = packing.optimal_boundaries(lengths, counts, k)
            assert len(got) <= k and got[-1] == lengths[-1] and _padding(every, got) == best


def test_packing(spark):
    params = packing.PackingParams(buckets=4, token_budget=200, max_len=150)
    got = packing.pack(tricky(spark), params=params).collect()
    rows = tricky_rows()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    size = lambda t: len(WORD.findall((t or "").encode()))
    batches = {}
    for r in got:
        assert r["n_tokens"] == size(r["text"]) <= r["bucket_len"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    full = {}
    for (bucket, batch), members in batches.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert len(members) == 1 or sum(max(1, r["bucket_len"]) for r in members) <= 200
        full.setdefault(bucket, {})[batch] = len(members)
    for sizes in full.values():
        assert sorted(sizes) == list(range(len(sizes))) and len({n for b, n in sizes.items() if b < len(sizes) - 1}) <= 1
    assert packing.pack(empty(spark)).count() == 0


def test_vocabulary_path_is_outside_the_repository():
    assert not os.path.realpath(BYTES).startswith(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


CLASHING = ("d1", "d2", "k1", "_k1", "_p1", "_p2", "_row", "b1", "_b1", "_d1", "_h", "n", "line", "_n", "found", "w", "starts", "row", "bucket")


def _clashing(spark):
    return tricky(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_columns_that_clash(spark, broadcast):
    docs, items = _clashing(spark), spark.createDataFrame([(1, tricky_rows()[9][1])], "item_id long, text string")
    lines = linededup.LineParams(min_sites=2, broadcast_lines=broadcast)
    for out in (linededup.drop_boilerplate(docs, lines), simhash.keep_one(docs), decontaminate.clean(docs, items)):
        assert set(docs.columns) <= set(out.columns) and {tuple(r) for r in out.select(*CLASHING).collect()} == {tuple(range(len(CLASHING)))}
    again = linededup.drop_boilerplate(docs, linededup.LineParams(min_sites=2)).select("doc_id", "text", "n_removed").collect()
    assert sorted(map(str, linededup.drop_boilerplate(docs, lines).select("doc_id", "text", "n_removed").collect())) == sorted(map(str, again))


def test_of_equal_texts_a_fixed_row_stays(spark):
    rows = [(1, "a b c d", f"s{k}") for k in range(20)] + [(None, "x y z", "s")] * 3
    kept = [sorted(map(str, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_items_beyond_the_broadcast(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(12, 30)))) for k in range(40)]
    docs = [(k, " ".join([*r.choices(words, k=20), t, *r.choices(words, k=9)]) if k % 2 else " ".join(r.choices(words, k=50))) for k, t in items]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small = decontaminate.matches(docs, items, decontaminate.DecontaminationParams(broadcast_balls=0, broadcast_shingles=0))
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    found = {(x["doc_id"], x["item_id"]) for x in small.collect()}
    assert found == {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(docs, items).collect()} == {(k, k) for k in range(1, 40, 2)}
