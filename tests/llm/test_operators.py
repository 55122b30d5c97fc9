"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import duck, duck_rows, spark_rows
from factline.llm import ann, chat, decontam, langid, licenses, packing, queries, simhash, substrings, tokenbin, tokencount
from factline.llm.bpe import Encoder

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, ids string"
ODD = [None, "", "   \n", "word", "Ünï cödé ½ 🙂 <|endoftext|> it's", "x" * 30000, "a b " * 5000]


def words_text(n, seed, vocabulary=2000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 2 else None, None, None, 1.5, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


# --- 1


def test_language_id_on_held_out_documents(spark):
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    assert len(found) == len(docs)
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.97
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert found.score.between(0, 1).all()


def test_language_id_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "de"), (4, "12 !!", None), (5, "the dog", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    rows = {r.doc_id: r for r in langid.identify(docs.withColumn("lang_pred", F.lit("zz")), model).collect()}
    assert (rows[5].lang_pred, rows[2].lang_pred, rows[3].lang_pred, rows[4].lang_pred) == ("en", "de", "und", "und")
    assert rows[3].score == 0
    unseen = docs_of(spark, ["thedogs", "Hunde"])
    assert [r.lang_pred for r in langid.identify(unseen, model).orderBy("doc_id").collect()] == ["en", "de"]
    assert langid.identify(docs.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert {r.doc_id for r in langid.accepted(docs, model, 0.5).collect()} == {1, 2, 5}


def test_backoff_uses_the_longest_known_grams():
    model = langid.Model(["a", "b"], {}, {"ab": 0, "x": 1}, np.zeros((0, 2)), np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert model.unseen("abx").tolist() == [1.0, 2.0]
    assert model.unseen("x").tolist() == [3.0, 4.0]
    assert model.unseen("q").tolist() == [0.0, 0.0]


# --- 2


def brute_neighbours(rows, k=20):
    rows = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            out[q] = sorted(((-float((x * y).sum()), i) for i, y in rows if i != q))[:k]
    return out


def test_neighbours_on_a_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    expected = brute_neighbours([(r.vec_id, r.embedding) for r in table.collect()])
    found = {}
    for r in ann.search(table).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert found.keys() == expected.keys()
    recall = np.mean([len({i for _, i in expected[q]} & {i for _, i, _ in found[q]}) / len(expected[q]) for q in found])
    assert recall >= 0.9
    for rows in found.values():
        assert [n for n, _, _ in sorted(rows)] == list(range(1, len(rows) + 1))


def test_neighbours_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 16)) * 4
    vectors = [(i, (centres[i % 40] + r.standard_normal(16)).tolist()) for i in range(2000)]
    expected = brute_neighbours(vectors)
    found = {}
    for row in ann.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    assert np.mean([len({i for _, i in expected[q]} & found[q]) / 20 for q in expected]) >= 0.9


def test_neighbours_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("id", F.lit(7))
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(table).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert ann.search(table.limit(0)).count() == 0


def test_equal_scores_go_to_the_smaller_ids(spark):
    r = random.Random(1)
    rows = [(i, [1.0, *[r.choice([-0.5, 0.25, 0.5]) for _ in range(11)]]) for i in range(1, 380)] + [(0, [2.0] + [0.0] * 11), (20, [1.0, 0.25] + [0.0] * 10), (1000, [1.0] + [0.0] * 11)]
    rows = list({i: (i, v) for i, v in rows}.values())
    expected = brute_neighbours(rows)
    found = {}
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append((-x.score, x.vec_id))
    assert found[0] == expected[0] == [(-2.0, i) for i in range(1, 21)]
    assert found.keys() == expected.keys()
    table, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for q, v in rows[::20]:
        (near, scores), = ann.nearest_rows(np.array([v]), table, ids, 21)
        assert [(-s, i) for i, s in zip(ids[near].tolist(), scores.tolist(), strict=True) if i != q][:20] == sorted((-float((np.array(v) * np.array(y)).sum()), i) for i, y in rows if i != q)[:20]


def test_hilbert_neighbours_are_a_step_apart():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# --- 3


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    base = words_text(300, 1).split()
    texts = [*ODD, ODD[3], *[" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in range(0, 300, 15)], *[words_text(20, s, 30) for s in range(60)]]
    docs = docs_of(spark, texts)
    expected = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    components = brute_components(expected)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in expected.items()}
    assert {i: r.component_id for i, r in found.items()} == components
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs_of(spark, ["a", None]).withColumn("doc_id", F.lit(None).cast("long"))).filter("component_id is null").count() == 2


@pytest.mark.parametrize("heavy", [4000, 3])
def test_close_links_lose_none(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    r = random.Random(4)
    prints, i = {}, 0
    for _ in range(25):
        centre = r.getrandbits(64)
        for _ in range(12):
            prints[i] = centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(6)))
            i += 1
    nodes = spark.createDataFrame([(k, simhash.signed(v)) for k, v in prints.items()], "id long, fp long")
    root = {k: k for k in prints}
    for row in simhash.components(simhash.close_links(nodes)).collect():
        root[row.node] = row.component
    assert root == brute_components(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)] + [(200, 199)]
    found = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}


def near_copy(text, edits, seed):
    words = text.split()
    for k in random.Random(seed).sample(range(len(words)), edits):
        words[k] = f"edit{k}"
    return " ".join(words)


def jaccard(a, b, n=5):
    a, b = ({tuple(x.split()[i : i + n]) for i in range(len(x.split()) - n + 1)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_close_fingerprints_are_candidates_without_a_band(spark):
    nodes = spark.createDataFrame([(1, 9, 0b1111, [11]), (2, 9, 0, [12]), (3, 9, 0b1111000, [13]), (4, 9, -1, [14]), (5, 9, 0, [15])], "id long, size int, fp long, bands array<long>")
    rows = simhash._key_rows(simhash.with_fingerprint_keys(nodes)).collect()
    assert sorted((r.id, r.first) for r in rows) == [(1, 1), (2, 1), (3, 1), (5, 1)]
    assert len({r.key for r in rows}) == 1
    texts = [f"a{i} " * 3 + " ".join(f"w{i}x{k}" for k in range(90)) for i in range(3)]
    prints = {r.doc_id: r.fp for r in simhash._features(docs_of(spark, [*texts, *texts]).select("doc_id", "text")).collect()}
    assert [prints[i] for i in range(3)] == [prints[i + 3] for i in range(3)]
    assert len(set(prints.values())) == 3


def test_one_of_each_near_copy(spark):
    texts = [words_text(200, s) for s in range(30)]
    copies = [near_copy(texts[s], 3, s) for s in range(20)] + [texts[3], texts[3].upper()]
    assert min(jaccard(texts[s], copies[s]) for s in range(20)) >= 0.8
    docs = docs_of(spark, [*texts, *copies, None, ""])
    left = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert left == [*range(30), 52]
    assert simhash.one_of_each(docs).columns == docs.columns


def test_near_copies_with_a_block_added_or_replaced_are_found(spark):
    texts = [words_text(200, 5000 + s, 10**6) for s in range(60)]
    added = [t + " " + words_text(45, 6000 + s, 10**6) for s, t in enumerate(texts[:30])]
    replaced = [" ".join([*t.split()[:90], *words_text(15, 7000 + s, 10**6).split(), *t.split()[105:]]) for s, t in enumerate(texts[30:])]
    assert all(0.8 <= jaccard(a, b) < 0.83 for a, b in zip(texts, added + replaced, strict=True))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs_of(spark, [*texts, *added, *replaced])).collect()) == list(range(60))


def reordered(text, piece, moved, seed):
    pieces = [text.split()[i : i + piece] for i in range(0, len(text.split()), piece)]
    places = random.Random(seed).sample(range(len(pieces)), moved)
    for a, b in zip(places[::2], places[1::2], strict=True):
        pieces[a], pieces[b] = pieces[b], pieces[a]
    return " ".join(w for p in pieces for w in p)


def test_near_copies_are_found_beside_a_looser_variant_of_smaller_id(spark):
    texts = [words_text(240, 8000 + s, 10**6) for s in range(20)]
    looser, copies = [reordered(t, 10, 20, 100 + s) for s, t in enumerate(texts)], [reordered(t, 20, 2, s) for s, t in enumerate(texts)]
    assert all(jaccard(t, c) >= 0.8 > max(jaccard(t, x), jaccard(c, x)) for t, x, c in zip(texts, looser, copies, strict=True))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs_of(spark, [*looser, *texts, *copies])).collect()) == list(range(40))


@pytest.mark.parametrize("size", [4, 4000])
def test_all_pairs_of_a_key_are_compared(spark, size):
    r = random.Random(3)
    texts = [words_text(120, 8100, 10**6)]
    for s in range(24):
        texts.append(near_copy(r.choice(texts), 3, s))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8]
    edges = spark.createDataFrame(pairs, "a long, b long")
    rows = spark.createDataFrame([(7, i, 120, i) for i in range(len(texts))], "key long, id long, size int, label long")
    links = [(x.a, x.b) for x in simhash.group_links(rows, docs_of(spark, texts).select("doc_id", "text"), size=size).collect()]
    assert {tuple(sorted(x)) for x in links} <= set(pairs)
    ours = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    theirs = simhash.components(edges).collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, theirs)) and len({c for _, c in map(tuple, theirs)}) > 1


# --- 4


def test_decontamination_equals_sql(spark, sf):
    ours = spark_rows(queries.op4_decontamination(spark, sf))
    assert ours == duck_rows(duck(sf), queries.OP4_SQL)


def brute_hits(text, items, window=10):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    hit, names = set(), set()
    for item, phrase in items:
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (phrase or "").encode().lower())
        size = min(window, len(own))
        for w in range(len(own) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[w : w + size]:
                    hit.update(range(i, i + size))
                    names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [500_000, 20])
def test_decontamination_cases(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    items = [(1, words_text(30, 5, 8)), (2, "Kurz UND gut"), (10, None), (11, ""), (1, words_text(14, 6, 8)), (3, "a " * 12)]
    texts = [*ODD, words_text(400, 7, 8), words_text(10, 1) + " " + items[0][1].upper() + ". kurz-und (gut)", items[4][1][:-1], "a A a," * 30, words_text(10, 1)]
    docs = docs_of(spark, [*texts, texts[-2]])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = {(r.doc_id, *[r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]) for r in decontam.contamination(docs, bench).collect()}
    assert found == {(i, *brute_hits(t, items)) for i, t in enumerate([*texts, texts[-2]])}
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())
    cleaned = decontam.removed(docs, bench)
    assert cleaned.columns == docs.columns
    assert cleaned.count() == len(texts) + 1
    assert not any(r.contaminated for r in decontam.contamination(cleaned, bench).collect())
    kept = {r.doc_id: r.text for r in cleaned.collect()}
    assert kept[len(texts) - 1] == texts[-1]
    assert kept[0] is None


@pytest.mark.parametrize("block", [500_000, 10])
def test_a_cut_that_joins_a_window_of_another_block_is_searched_again(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(10))) for k in range(8)]
    nested = items[0][1].split()
    for _, text in items[1:]:
        nested[5:5] = text.split()
    bench = spark.createDataFrame(items, "item_id long, text string")
    cleaned = decontam.removed(docs_of(spark, ["pre " + " ".join(nested) + " post", "clean"]), bench)
    assert [r.text for r in cleaned.orderBy("doc_id").collect()] == ["pre  post", "clean"]


# --- 5


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    passage, near = words_text(60, 900), words_text(80, 901)
    texts = [words_text(150, s) for s in range(20)]
    texts[3] = words_text(40, 30) + " " + passage + ". " + words_text(40, 31)
    texts[9] = words_text(10, 32) + "\n" + passage.upper() + " " + words_text(90, 33)
    texts[14] = passage
    texts[5] = words_text(40, 34) + " " + near + " " + words_text(40, 35)
    texts[11] = words_text(40, 36) + " " + near_copy(near, 1, 1) + " " + words_text(40, 37)
    docs = docs_of(spark, [*texts, None, "", texts[0]])
    found = {r.doc_id: r for r in substrings.repeated_passages(docs).collect()}
    assert found.keys() == {9, 14, 11, 22}
    assert found[9].other_ids == [3]
    assert (found[9].passages[0].first, found[9].passages[0].end) == (10, 70)
    assert found[14].n_repeated == 60
    assert found[22].n_repeated == 150
    cleaned = {r.doc_id: r.text for r in substrings.cleaned(docs).collect()}
    assert len(cleaned) == 23
    assert cleaned[3] == texts[3]
    assert cleaned[9] == texts[9].replace(passage.upper(), "")
    assert cleaned[14] == ""
    assert cleaned[20] is None
    assert all(cleaned[i] == texts[i] for i in range(20) if i not in (9, 14, 11))
    assert substrings.repeated_passages(docs.limit(0)).count() == 0


def exact_passages(rows, size=substrings.PASSAGE):
    """Per document the words in runs that a document of smaller id has too."""
    first, hit = {}, {}
    for doc, text in rows:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i : i + size]), doc) != doc:
                hit.setdefault(doc, set()).update(range(i, i + size))
    return hit


def found_words(df):
    return {r.doc_id: {k for p in r.passages for k in range(p.first, p.end)} for r in df.collect()}


def test_every_exact_passage_of_a_table_is_found(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    needed = exact_passages([tuple(r) for r in table.collect()])
    found = found_words(queries.op5_repeated_passages(spark, "/root/testdata/sf0.01"))
    assert all(words <= found.get(doc, set()) for doc, words in needed.items())
    assert len(found.keys() - needed.keys()) <= 0.2 * len(needed)


def test_phrases_of_smaller_ids_take_no_passage_away(spark):
    passage = words_text(56, 400, 10**6).split()
    phrases = [" ".join([words_text(30, 401 + k, 10**6), *passage[k : k + 5 + k % 40], words_text(30, 480 + k, 10**6)]) for k in range(0, 52, 2)]
    holders = [words_text(30 + s, 500 + s, 10**6) + " " + " ".join(passage) + " " + words_text(30, 520 + s, 10**6) for s in range(3)]
    texts = [*phrases, *holders]
    n = len(phrases)
    expected = exact_passages(enumerate(texts))
    assert expected.keys() == {n + 1, n + 2}
    assert found_words(substrings.repeated_passages(docs_of(spark, texts))) == expected


def test_edited_passages_are_found_beside_looser_ones(spark):
    kinds = {"replaced": 0, "inserted": 0, "deleted": 0}
    texts, twins = [], []
    for s in range(120):
        r, kind = random.Random(s), list(kinds)[s % 3]
        passage = words_text(60, 600 + s, 10**6).split()
        edited, looser = list(passage), list(passage)
        k = r.randrange(20, 40)
        edited[k : k + (kind != "inserted")] = [] if kind == "deleted" else [f"new{s}"]
        for x in (8, 22, 36, 50):
            looser[x] = f"loose{s}x{x}"
        for x in (looser, passage, edited):
            texts.append(f"{words_text(20, 7000 + len(texts), 10**6)} {' '.join(x)} {words_text(20, 8000 + len(texts), 10**6)}")
        assert jaccard(" ".join(passage), " ".join(edited)) >= 0.8 > 0.6 > jaccard(" ".join(looser), " ".join(edited))
        twins.append((len(texts) - 1, kind))
    found = found_words(substrings.repeated_passages(docs_of(spark, texts)))
    assert found.keys() <= {t for t, _ in twins}
    assert sum(t in found for t, _ in twins) >= 0.9 * len(twins)


@pytest.mark.parametrize("kind", ["inserted", "moved"])
def test_passages_edited_by_more_than_a_few_words_are_found(spark, kind):
    texts = []
    for s in range(60):
        passage = words_text(52 if kind == "moved" else 70, 10_000 + s, 10**6).split()
        block = words_text(5, 10_100 + s, 10**6).split()
        edited = passage[26:] + passage[:26] if kind == "moved" else [*passage[:35], *block, *passage[35:]]
        assert jaccard(" ".join(passage), " ".join(edited)) >= 0.8
        texts += [f"{words_text(20, 11_000 + 2 * s + k, 10**6)} {' '.join(x)} {words_text(20, 12_000 + 2 * s + k, 10**6)}" for k, x in enumerate((passage, edited))]
    found = found_words(substrings.repeated_passages(docs_of(spark, texts)))
    assert all(doc % 2 for doc in found)
    assert len(found) >= 0.65 * 60


def edited_windows(n, seed):
    """Texts of one eleven-word phrase in unlike surroundings, each sixth beside an edited one of a larger id, which comes last."""
    phrase = words_text(11, seed, 10**6)
    sides = [(words_text(30, seed + 10 * k + 1, 10**6).split(), words_text(30, seed + 10 * k + 2, 10**6).split()) for k in range(n)]
    late = [(left[:25] + ["edited"] + left[26:], right) for left, right in sides[::6]]
    return [" ".join([*left, phrase, *right]) for left, right in [*sides, *late]]


@pytest.mark.parametrize(("anchors", "block"), [(16, 2000), (2, 7), (2, 60)])
def test_edited_passages_of_a_phrase_of_very_many_documents_are_found(spark, monkeypatch, anchors, block):
    monkeypatch.setattr(substrings, "ANCHORS", anchors)
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "WHOLE", block)
    texts = edited_windows(120, 20_000)
    words = np.zeros((len(texts), substrings._SIDE), np.uint8)
    codes, _, _ = substrings.word_lists([t.encode() for t in texts])
    for k, code in enumerate(codes):  # 71 words, the phrase's first in column REACH
        words[k, substrings.REACH - 30 :][: len(code)] = np.maximum(code & 255, 1)
    reach = np.full(len(texts), 30)
    sides = substrings.Sides(np.full(len(texts), 5), np.arange(len(texts)), np.full(len(texts), 30), reach, reach + 6, words, np.ones(len(texts), bool))
    batch = sides.rows(substrings.EDITED, np.arange(len(texts)))
    settled = pa.Table.from_batches(list(substrings._settled(iter([batch.slice(k, 50) for k in range(0, len(texts), 50)])))).to_pandas()
    frame = spark.createDataFrame([tuple(None if c is None or c != c else c for c in r) for r in settled.itertuples(index=False)], substrings.ROWS)
    links = {(r.doc_id, r.key) for r in frame.filter(F.col("kind") == substrings.LINK).unionByName(substrings._rest_links(frame.filter(F.col("kind") == substrings.REST))).collect()}
    assert links == {(120 + k, 6 * k) for k in range(20)}


def test_windows_kept_apart_from_alignment_hold_no_passage():
    r = random.Random(5)
    rows = []
    for _ in range(60):
        row = [r.randrange(1, r.choice((4, 256))) for _ in range(substrings._SIDE)]
        for _ in range(10):
            other = list(row)
            for _ in range(r.randrange(4)):
                a, b, n = r.randrange(80), r.randrange(80), r.randrange(1, 12)
                taken = other[a : a + n]
                del other[a : a + n]
                other[b:b] = r.choice((taken, taken[::-1], taken * 2))
            other = (other + [0] * substrings._SIDE)[: substrings._SIDE]
            rows.append((row, other))
    x, y = (np.array([p[k] for p in rows], np.uint8) for k in (0, 1))
    passed = substrings.may_align(x, y)
    stands = np.array([bool(substrings.alike(a, b[b > 0])) for a, b in zip(x, y, strict=True)])
    assert 100 < stands.sum() < 600
    assert not (stands & ~passed).any()


def one_word_runs(n, seed):
    """Windows under one key that begin with eleven and more of one word, and go on with runs of others."""
    r = random.Random(seed)
    words = np.zeros((n, substrings._SIDE), np.uint8)
    for k in range(n):
        at = substrings.REACH
        size = r.randrange(11, 25)
        while at < substrings._SIDE:
            words[k, at : at + size] = 53 if at == substrings.REACH else r.randrange(1, 200)
            at, size = at + size, r.randrange(8, 30)
    back = np.zeros(n, np.int64)
    return substrings.Sides(np.full(n, 5), np.arange(n), np.full(n, 30), back, back + substrings.REACH, words, np.ones(n, bool))


def test_windows_of_one_word_runs_are_compared_with_few_others(monkeypatch):
    sides, plain, compared, seen = one_word_runs(400, 3), one_word_runs(400, 3), substrings.Sides.compared, []
    monkeypatch.setattr(substrings.Sides, "compared", lambda self, i, j: seen.append(len(i)) or compared(self, i, j))
    links = sides.all_linked()
    few = sum(seen)
    expected, _ = plain.linked(400)
    assert {(a, b) for a, b in zip(links.column("doc_id").to_pylist(), links.column("key").to_pylist(), strict=True)} == {(a, b) for a, b in zip(expected.column("doc_id").to_pylist(), expected.column("key").to_pylist(), strict=True)}
    assert links.num_rows > 10
    assert few < (sum(seen) - few) / 10


def test_no_pair_that_holds_a_passage_is_left_out():
    r = random.Random(8)
    sides = one_word_runs(60, 4)
    for k in range(0, 60, 2):  # others differ in a few words
        sides.words[k + 1] = sides.words[k]
        for _ in range(r.randrange(1, 9)):
            sides.words[k + 1, substrings.REACH + 11 + r.randrange(39)] = r.randrange(1, 200)
        if k % 4:
            sides.words[k : k + 2, substrings.REACH + 11 :] = np.array([r.randrange(1, 255) for _ in range(39)])
            sides.words[k + 1, substrings.REACH + 11 + r.randrange(39)] = 255
    sides.words[:, substrings.REACH + substrings.PASSAGE :] = 0
    own, other = sides.partners()
    kept = set(zip(own.tolist(), other.tolist(), strict=True))
    i, j = (c.ravel() for c in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    i, j = i[j < i], j[j < i]
    copy, begin, end, moved = sides.compared(i, j)
    stands = copy | (end > begin) | np.array([bool(m and substrings.alike(sides.own(a), sides.own(b))) for a, b, m in zip(i.tolist(), j.tolist(), moved.tolist(), strict=True)])
    assert stands.sum() > 10
    assert {(int(a), int(b)) for a, b in zip(i[stands], j[stands], strict=True)} <= kept


def edited_rows(n, seed):
    """Windows of one key with a few words replaced in each, or cut out, put in or moved; some are of runs of one word."""
    r = random.Random(seed)
    base = [r.randrange(1, 255) for _ in range(substrings._SIDE)]
    words = np.zeros((n, substrings._SIDE), np.uint8)
    for k in range(n):
        row = list(base)
        for _ in range(r.randrange(1, 14)):
            a, b, size = r.randrange(95), r.randrange(95), r.randrange(1, 4)
            taken = row[a : a + size]
            row[a : a + size] = r.choice(([r.randrange(1, 255) for _ in taken],) * 6 + ([], [taken[0]] * 12, taken * 2) if taken else ([],))
            if r.random() < 0.1:
                row[b:b] = taken
        row[45:56] = base[45:56]
        words[k] = (row + [7] * substrings._SIDE)[: substrings._SIDE]
    reach = np.full(n, substrings.REACH)
    words[n // 2 :, : substrings.REACH - 10] = 0
    return substrings.Sides(np.full(n, 5), np.arange(n), np.full(n, 60), np.where(np.arange(n) < n // 2, reach, 10), reach, words, np.ones(n, bool))


def test_runs_that_stand_are_those_of_plain_alignment():
    sides = edited_rows(60, 11)
    i, j = (c.ravel() for c in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    pair, first, end = substrings.standing(sides.words[i], sides.words[j])
    found = {k: [] for k in range(len(i))}
    for k, a, b in zip(pair.tolist(), first.tolist(), end.tolist(), strict=True):
        found[k].append((a - substrings.REACH + int(sides.back[i[k]]), b - substrings.REACH + int(sides.back[i[k]])))
    expected = {k: substrings.alike(sides.own(a), sides.own(b)) for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True))}
    assert found == expected
    assert 100 < sum(map(bool, expected.values())) < 3000


def test_words_are_compared_only_where_shingles_stand_in_order(monkeypatch):
    sides, plain, compared, seen = edited_rows(300, 12), edited_rows(300, 12), substrings.Sides.compared, []
    monkeypatch.setattr(substrings.Sides, "compared", lambda self, i, j: seen.append(len(i)) or compared(self, i, j))
    links = sides.all_linked()
    few = sum(seen)
    expected, _ = plain.linked(300)
    assert links.num_rows > 50
    assert set(links.column("doc_id").to_pylist()) >= set(expected.column("doc_id").to_pylist())
    assert few < (sum(seen) - few) / 10


@pytest.mark.parametrize("size", [7, 1000])
def test_equal_windows_of_many_documents_are_dealt_once(size):
    words = np.random.default_rng(4).integers(1, 255, (20, substrings._SIDE)).astype(np.uint8)
    words[:, substrings.REACH : substrings.REACH + 11] = 9
    which = np.concatenate([np.arange(20), np.tile([16, 17, 18, 19, 3], 8)])
    n, reach = len(which), np.full(len(which), substrings.REACH)
    check = np.where(np.arange(n) == 30, 1, 0).astype(np.uint32)  # the same bytes, and other words
    sides = substrings.Sides(np.full(n, 5), np.arange(n), np.full(n, 60), reach, reach, words[which], np.ones(n, bool), check=check)
    batch = sides.rows(substrings.EDITED, np.arange(n))
    settled = pa.Table.from_batches(list(substrings._settled(iter([batch.slice(k, size) for k in range(0, n, size)]))))
    rest = settled.filter(pa.array(settled.column("kind").to_numpy() == substrings.REST))
    assert which[30] == 16
    assert sorted(rest.column("doc_id").to_pylist()) == [16, 17, 18, 19, 30]


def test_cleaned_keeps_other_columns_and_tells_texts_of_one_id_apart(spark):
    passage = words_text(60, 70)
    rows = [(1, passage), (2, words_text(20, 71) + " " + passage), (2, words_text(90, 72)), (None, passage), (3, "short"), (4, "x " * 30000 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_sides", F.lit(1)).withColumn("_side_id", F.lit(2)).withColumn("row", F.lit(3)).withColumn("texts", F.lit("t"))
    out = substrings.cleaned(docs)
    assert out.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text, r["_sides"], r["texts"]) for r in out.collect())
    assert left == sorted([(1, passage, 1, "t"), (2, words_text(20, 71) + " ", 1, "t"), (2, words_text(90, 72), 1, "t"), (0, passage, 1, "t"), (3, "short", 1, "t"), (4, "x " * 30000, 1, "t")])
    assert substrings.cleaned(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 11, 50])
def test_grams_tell_runs_apart(n):
    words = np.random.default_rng(n).integers(0, 3, 300, dtype=np.uint64)
    found = substrings.grams(words, n)
    assert len(found) == 300 - n + 1
    runs = [tuple(words[i : i + n]) for i in range(len(found))]
    assert len(set(zip(runs, found.tolist(), strict=True))) == len(set(runs)) == len(set(found.tolist()))


@pytest.mark.parametrize("seed", range(5))
def test_compact_windows_are_those_of_the_cartesian_tree(seed):
    r = np.random.default_rng(seed)
    hashes = r.integers(1, 50 if seed % 2 else 1 << 60, 200, dtype=np.uint64)
    owner = np.sort(r.integers(0, 4, 200))
    nodes, back, ahead = substrings.compact_windows(hashes, owner, 7)
    found = set(zip(nodes.tolist(), (nodes - back).tolist(), (nodes + ahead).tolist()))
    expected = set()
    for i in range(200):
        a = b = i
        while a and owner[a - 1] == owner[i] and hashes[a - 1] > hashes[i]:
            a -= 1
        while b < 199 and owner[b + 1] == owner[i] and hashes[b + 1] >= hashes[i]:
            b += 1
        if b - a + 1 >= 7:
            expected.add((i, a, b))
    assert expected <= found


# --- 6, 9: the encoder


@pytest.mark.parametrize("seed", range(8))
def test_encoder_equals_the_library(tokenizer, seed):
    r = random.Random(seed)
    alphabet = "abcXYZ  \t\n'',.!?0123½²éÉßİıŉſªµ’“🙂ÅΣς́\x1c\x85\xa0中<|endoftext|>" + ("" if seed % 2 else "stmrevd" * 5)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(80)] + ["it's we've I'LL <|startoftext|>", "", "ab" * 3000]
    ours = Encoder(BPE, cache_words=50).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ours] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_token_file_round_trip(spark, tokenizer, tmp_path):
    texts = [*ODD, *[words_text(50, s) for s in range(400)]]
    docs = docs_of(spark, texts).orderBy(F.rand(3)).union(docs_of(spark, [None], 9000))
    path = f"file://{tmp_path}/ids"
    tokenbin.write(docs, path, BPE)
    found = sorted(tuple(r) for r in tokenbin.read(spark, path).collect())
    expected, before = [], 0
    for i, t in [*enumerate(texts), (9000, None)]:
        ids = ids_of(tokenizer, t)
        expected.append((i, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert found == expected
    assert tokenbin.lookup(spark, path, 4) == [ids_of(tokenizer, texts[4]).tolist()]
    assert tokenbin.lookup(spark, path, 300) == [ids_of(tokenizer, texts[300]).tolist()]
    assert tokenbin.lookup(spark, path, 100000) == []


def test_token_file_cases(spark, tmp_path):
    docs = docs_of(spark, ["a", "b"]).withColumn("doc_id", F.lit(5))
    tokenbin.write(docs, f"file://{tmp_path}/x", BPE)
    assert sorted(r.start for r in tokenbin.read(spark, f"file://{tmp_path}/x").collect()) == [0, 2]
    tokenbin.write(docs.limit(0), f"file://{tmp_path}/y", BPE)
    assert tokenbin.read(spark, f"file://{tmp_path}/y").count() == 0


def test_token_file_refuses_another_dictionary(spark, tmp_path):
    tokenbin.write(docs_of(spark, ["a b"]), f"file://{tmp_path}/x", BPE)
    spark.createDataFrame([("other", 2, bytearray(b""))], "dictionary string, width int, bytes binary").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/x/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        tokenbin.read(spark, f"file://{tmp_path}/x").collect()


# --- 7


def test_chat_equals_sql(spark, sf):
    ours = spark_rows(queries.op7_chat_format(spark, sf))
    assert ours == duck_rows(duck(sf), queries.OP7_SQL)


def test_chat_cases(spark):
    nasty = r"\ \\ [INST] \[INST] </s> <|role|>x<|text|> {{ m }} {% if %}"
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", nasty), (1, 2, None, None), (1, 2, None, None), (None, 0, "assistant", ""), (2, 0, nasty, "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    found = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert chat.parse_formatted(found[1].formatted) == [("user", nasty), ("assistant", nasty), ("", ""), ("", "")]
    assert chat.parse_formatted(found[2].formatted) == [(nasty, "t")]
    span = found[1].loss[0]
    assert chat.unescape(found[1].formatted[span.start : span.end]) == nasty
    assert found[None].formatted == "<|assistant|></s>"
    assert chat.format_conversations(table.limit(0)).count() == 0
    assert {r.n_turns for r in chat.digests(chat.format_conversations(table)).collect()} == {1, 4}


def test_templates():
    m = [{"role": "user", "text": " a "}]
    assert chat.compile_template("{{ 'x' + 'y' | upper }}{% if 1 == 2 %}no{% else %}yes{% endif %}!")(m) == ("xYyes!", [])
    assert chat.simplified(chat.Parser("a{{ 'b' }}{% if 'x' %}c{% endif %}").body()[0]) == [("text", "abc")]
    assert chat.compile_template("{% for m in messages %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% endfor %}")(m) == ("a", [(0, 1)])
    for bad in ("{{ m.__class__ }", "{{ open('x') }}", "{% for x in messages %}", "{{ m | eval }}", "{% import os %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            if chat.compile_template(bad)(m)[0] == bad:
                raise chat.TemplateError("plain text")
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ messages.append }}")(m)


# --- 8


def test_license_scan(spark):
    statements = {f: t[0] for f, t in licenses.TEMPLATES.items()}
    clean = [words_text(30, s, 400) + ".\n" + words_text(12, s + 50, 400) for s in range(60)]
    texts = [*clean, *[words_text(20, 7) + ".\n" + s for s in statements.values()], "This work is licensed under the gnu general public license version 3", "The licence fee was paid by the driver.", None, ""]
    docs = docs_of(spark, texts).withColumn("family", F.lit("x"))
    scanner = licenses.train(docs)
    found = {r.doc_id: r for r in licenses.scan(docs, scanner).collect()}
    n = len(clean)
    assert {i: r.family for i, r in found.items()} == {**{n + k: f for k, f in enumerate(statements)}, n + len(statements): "gpl"}
    assert all(r.probability >= scanner.needed and r.likeness >= licenses.CONFIRM for r in found.values())
    assert licenses.scan(docs.limit(0), scanner).count() == 0
    # As they stand in files: wrapped, in comments, as headings and tags.
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n *\n * 1. Redistributions of source code"
    apache = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n'
    wanted = [("mit", mit), ("gpl", gpl), ("bsd", bsd), ("apache-2.0", apache), ("mit", "MIT License\n\nCopyright (c) 2020 Someone"), ("mit", "// SPDX-License-Identifier: MIT\n"), ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later")]
    files = docs_of(spark, [text for _, text in wanted] + [words_text(20000, 3, 400), *clean[:20]])
    got = {}
    for r in licenses.scan(files, scanner).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    first = min(r.doc_id for r in files.select("doc_id").collect())
    assert all(f in got.get(first + i, set()) for i, (f, _) in enumerate(wanted)), got
    assert set(got) <= {first + i for i in range(len(wanted))}
    # What isn't scored could not have been confirmed: every template, less any run of words that leaves its share.
    telling = set(licenses.telling_words())
    for texts_of in licenses.TEMPLATES.values():
        for template in texts_of:
            ws = re.findall(r"[a-z0-9]+", template.lower())
            own = list(zip(ws, ws[1:]))
            silent = {p for p in own if not telling & set(p)}
            assert len(silent) < licenses.CONFIRM * len(set(own)), template
    cases = ["UNDER_LICENSE", "relicensed", "the\tMozilla", "nothing", "(Licensed)", None]
    said = spark.createDataFrame([(c,) for c in cases], "t string").select(licenses.may_state(F.col("t")).alias("said")).collect()
    assert [r.said for r in said] == [True, False, True, False, True, None]
    # Probabilities are those of the plain sums over the model's weights.
    rows = licenses._hashed(licenses.paragraphs(docs, "doc_id", "text"))
    scored = licenses._probabilities(scanner.model, licenses.paragraphs(docs, "doc_id", "text")).collect()
    weights, base = scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray()
    vectors = {(r.doc_id, r.paragraph): r.features.indices for r in rows.collect()}
    for r in scored:
        z = base + weights[:, vectors[r.doc_id, r.paragraph]].sum(axis=1)
        e = np.exp(z - z.max())
        assert np.allclose(e / e.sum(), r.probabilities)


def test_license_model_learns_from_every_paragraph_that_might_be_scored(spark, monkeypatch):
    held, save = [], licenses.save
    monkeypatch.setattr(licenses, "save", lambda df, tag: held.append(save(df, tag)) or held[-1])
    texts = [f"The software was sold in town {k % 900}. Nothing else was said there." for k in range(3000)]
    scanner = licenses.train(docs_of(spark, [*texts, "This software is under the MIT license."]))
    assert held[0].agg(F.sum("n")).first()[0] == 3000 + len(licenses.PROSE)
    assert 0.5 <= scanner.needed <= 1


def test_a_threshold_is_exceeded_by_no_more_than_its_share(monkeypatch):
    monkeypatch.setattr(licenses, "FALSE_RATE", 0.1)
    r = random.Random(3)
    values = [r.randrange(licenses.STEPS) for _ in range(500)]
    needed = licenses.least_reached({v: values.count(v) for v in values}) * licenses.STEPS
    assert sum(v > needed + 1e-6 for v in values) <= 50 < sum(v >= needed - 1e-6 for v in values)
    assert licenses.least_reached({}) == 0


# --- 9


def check_packing(rows, expected, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for i, ids in expected.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert 0 < size <= window
        padding += 0 if size & size - 1 == 0 else window - size
    return padding


def test_packing(spark, tokenizer):
    texts = [*ODD, *[". ".join(words_text(12, 40 * s + k) for k in range(40)) for s in range(60)]]
    found = packing.pack(docs_of(spark, texts).repartition(3), BPE, 256).collect()
    expected = {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}
    total = sum(map(len, expected.values()))
    assert check_packing(found, expected, 256) < 0.12 * total
    assert packing.pack(docs_of(spark, texts).limit(0), BPE).count() == 0


def test_packing_over_several_flushes(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "STREAM_TOKENS", 500)
    texts = [words_text(40 + s, s) for s in range(80)]
    found = packing.pack(docs_of(spark, texts).coalesce(1), BPE, 128).collect()
    check_packing(found, {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}, 128)


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_the_best_ones(seed):
    r = random.Random(seed)
    places = sorted({0, 60, *r.sample(range(1, 60), 14)})
    if max(b - a for a, b in itertools.pairwise(places)) > 16:
        return
    penalties = [0 if p == 0 else r.choice([0, 2, 9]) for p in places]

    def cost(cuts):
        return sum(16 - (places[b] - places[a]) + penalties[b] if places[b] - places[a] <= 16 else 10**6 for a, b in itertools.pairwise(cuts))

    n = len(places)
    least = min(cost([0, *inner, n - 1]) for k in range(n - 1) for inner in itertools.combinations(range(1, n - 1), k))
    assert cost(packing.best_cuts(places, penalties, 16)) == least


# --- 10


def brute_count(scores, word):
    best = [(0.0, 0)] + [(-float("inf"), 0)] * len(word)
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        options = [(best[e - 1][0] + n * tokencount.BYTE_SCORE, -(best[e - 1][1] + n))]
        options += [(best[s][0] + scores[word[s:e]], -(best[s][1] + 1)) for s in range(e) if word[s:e] in scores]
        top = max(options)
        best[e] = (top[0], -top[1])
    return best[-1][1]


def test_token_counts(spark):
    texts = [*[t for t in ODD if t is None or len(t) < 1000], "Hello world hello", "naïve 中文 🙂🙂 xyzzyq", words_text(300, 1)]
    scores = tokencount.model(PIECES).scores
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.count_tokens(docs_of(spark, texts), PIECES).collect()}
    assert found == {i: (len((t or "").split()), sum(brute_count(scores, tokencount.WORD_MARK + w) for w in (t or "").split())) for i, t in enumerate(texts)}
    assert tokencount.count_tokens(docs_of(spark, texts).limit(0), PIECES).count() == 0


def test_shared_prefixes_change_no_count():
    scores = {"▁a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -1.9, "c": -2.0, "bc": -2.5}
    unigram = tokencount.Unigram(scores, cache_words=3)
    words = ["".join(x) for n in range(1, 5) for x in itertools.product("abcd", repeat=n)]
    assert [n for w in words for _, n in unigram.counts([w])] == [brute_count(scores, tokencount.WORD_MARK + w) for w in words]
    assert tokencount.Unigram(scores).counts([" ".join(words)])[0][1] == sum(brute_count(scores, tokencount.WORD_MARK + w) for w in words)
