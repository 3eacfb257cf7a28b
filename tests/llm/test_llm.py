"""The training-data operators against brute force, SQL, round trips and odd rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, html_extract, language_id, mixing, near, ngram_join, quality, sentencepiece_codec, sharding, substring_dedup, url_filter
from ledgerloom.llm.near import connected_components
from ledgerloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, node long, component string, size int, url string, html string, page_id long"
PROSE = " ".join(f"word{i % 97}x{i}" for i in range(400))


def odd_rows():
    near = " ".join([*PROSE.split()[:395], "a", "b", "c", "d", "e"])
    texts = [None, "", "   \n\t", "One", "one", PROSE, PROSE, PROSE.upper(), near, "é́ 日本 🙂\0 x", "x" * 9000, "a b c d e f g h\n" * 50, "İ ſ K Å", None, "the end of it"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", None, 7, "c", 1, f"http://h{i}", t, i) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[3], (None, PROSE, "en", "s", True, 1, "c", 1, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert ours == sorted(result.fetchall(), key=repr)


def test_exact_dedup_of_odd_rows(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    groups = Counter(fold(r[1]) for r in odd_rows())
    assert len(rows) == len(odd_rows())
    assert Counter(r["text_sha256"] for r in rows) == Counter({hashlib.sha256(t.encode()).hexdigest(): n for t, n in groups.items()})
    assert all(r["group_size"] == sum(x["text_sha256"] == r["text_sha256"] for x in rows) for r in rows)
    assert Counter(r["text_sha256"] for r in rows if r["kept"]) == Counter({r["text_sha256"]: 1 for r in rows})
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.keep_first_copies(none).count() == 0


def test_chunks_are_the_text_and_realign(spark):
    rng = random.Random(40)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(4, 20))) + rng.choice(". . ? \n".split(" ")) + " "
    body = "".join(sentence() for _ in range(400))
    texts = [body, "xy " + body, "".join(sentence() for _ in range(9)) + body, body[:9000] + "new words. " + body[9000:], "Aa b. " * 3000 + "\n" + "x" * 20_000, "", "\u65e5\u672c\u3002" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", exact_dedup.chunks(F.col("text")).alias("c"))
    cut = {r["i"]: r["c"] for r in df.collect()}
    assert ["".join(cut[i]) for i in range(len(texts))] == texts and 30 < len(cut[0]) < 80
    for i in (1, 2, 3):
        assert len(set(cut[i]) & set(cut[0])) >= len(cut[0]) - 2
    docs = spark.createDataFrame(list(enumerate(texts[:4])), "doc_id long, text string")
    assert exact_dedup.chunk_store(docs).count() < 0.5 * sum(len(cut[i]) for i in range(4))


def test_quality_of_odd_rows(odd, none):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality.assess(odd).collect()}
    for doc_id, text, *_ in odd_rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        row = rows[doc_id, len(words)]
        assert (row["n_repeat_words"], row["word_chars"]) == (len(covered), sum(map(len, words)))
    assert quality.assess(none).count() == 0
    assert quality.filter_rows(odd).columns == odd.columns


def test_cascade_orders_by_rejection_per_cost():
    a, b, c = (quality.Rule(n, lambda t: t) for n in "abc")
    assert [r.name for r in quality.ordered([(a, 1.0, 0.1), (b, 0.1, 0.05), (c, 1.0, 0.0)])] == ["b", "a", "c"]


def test_mix_meets_targets(odd, none):
    rows = mixing.plan(odd).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        words = sum(p["words"] for p in r["passes"])
        taken[r["source"]] += words
        assert words <= 2 * r["size"]
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert taken[r["source"]] == int(r["target"] + 0.5) and r["source_size"] == sizes[r["source"]]
    assert mixing.plan(none).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(odd.repartition(5)).collect()))


def test_mix_gives_equal_rows_their_own_places(spark):
    rows = [(1, "w " * 10, "a", "p")] * 3 + [(i, "w " * 10, "ab"[i % 2], "p") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position string").withColumns({"pass": F.lit(1), "row": F.lit("r"), "_row": F.lit(2)})
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    counts = Counter(r["doc_id"] for r in got.collect())
    assert counts[1] <= 6 and max(n for i, n in counts.items() if i != 1) <= 2 and abs(sum(counts.values()) - 1.5 * len(rows)) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    order = [r["source"] for r in mixing.training_order(mixing.plan(docs)).collect()]
    # the first source's weight falls from 4.5 to 1.5, the second's rises from 0.5 to 1.5
    half = len(order) // 2
    assert Counter(order[:half])["a"] > Counter(order[half:])["a"]


def test_shards_are_even_and_stay(odd, none):
    names = [f"n{i}" for i in range(10)]
    before, after = sharding.fill_table(names, 1009), sharding.fill_table(names[:-1], 1009)
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert np.mean([a == b for a, b in zip(before, after, strict=True) if a != 9]) > 0.8
    placed = sharding.assign(odd, "doc_id", names, 1009)
    assert placed.count() == len(odd_rows()) and sharding.assign(none, "doc_id", names, 1009).count() == 0
    for r in placed.select("doc_id", "shard_slot", "shard").collect():
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:15], 16) % 1009
        assert (r["shard_slot"], r["shard"]) == (slot, before[slot])


def test_codec_is_the_library_and_spans_cover(odd, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.load(path)
    rng = random.Random(4)
    texts = ["", " ", "▁", " ▁ a", "a\n\nb", "\0", *("".join(rng.choices("ab ▁\n\té日🙂<>s/.!", k=rng.randint(0, 40))) for _ in range(3000))]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        spans = codec.spans(text, ids)
        if len(ids):
            assert spans[0, 0] == 0 and spans[-1, 1] == len(text.encode()) and (spans[1:, 0] == spans[:-1, 1]).all()
    rows = sentencepiece_codec.digest(odd, path).collect()
    assert Counter(r["ids_sha256"] for r in rows) == Counter(hashlib.sha256(",".join(map(str, library.encode(r[1] or ""))).encode()).hexdigest() for r in odd_rows())
    assert sentencepiece_codec.digest(none, path).count() == 0
    rng = random.Random(44)
    for text in (PROSE[:900], "a  b\n\nc é日🙂 <s>", *("".join(rng.choices("ab \n\té日🙂<>s/.!", k=30)) for _ in range(60))):
        pieces = library.encode(text, return_type="proto").pieces
        whole = [(p.begin, p.end) for p in pieces]
        ours = [tuple(map(int, s)) for s in codec.spans(text, codec.encode(text))]
        # bytes of a character that no piece has are pieces of it; the library gives the character to the last of them
        assert all(a == b for a, b, p in zip(ours, whole, pieces, strict=True) if not p.piece.startswith("<0x"))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd.where("doc_id = 9"), path), path).first()["text"]
    assert back == library.decode(library.encode(odd_rows()[9][1]))


def test_character_map_takes_the_longest_prefix():
    # a double array by hand for "a" -> "X" and "ab" -> "YZ"
    units = [0] * 1024
    leaf = lambda value: value | 1 << 31
    units[0] = 256 << 10
    units[256 ^ ord("a")] = ord("a") | 1 << 8 | ((256 ^ ord("a")) ^ 512) << 10
    units[512] = leaf(0)
    units[512 ^ ord("b")] = ord("b") | 1 << 8 | ((512 ^ ord("b")) ^ 768) << 10
    units[768] = leaf(2)
    blob = np.array(units, dtype="<u4").tobytes()
    table = sentencepiece_codec.CharMap(len(blob).to_bytes(4, "little") + blob + b"X\0YZ\0")
    assert table.longest(b"abc", 0) == (2, b"YZ")
    assert table.longest(b"ac", 0) == (1, b"X")
    assert table.longest(b"ca", 0) is None


def longest_phrases(text, training):
    at = n = 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in training:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    samples = tuple((name, "".join(rng.choices(letters, k=300))) for name, letters in (("aa", "abc "), ("bb", "abd ")))
    model = language_id.fit(samples)
    clean = lambda t: re.sub(" +", " ", t)
    for _ in range(50):
        text = "".join(rng.choices("abcde ", k=rng.randint(1, 200)))
        found = language_id.phrases(model, [language_id.encode(text, model.codes)])[0]
        assert found.tolist() == [longest_phrases(clean(text), clean(t)) for _, t in samples]


def test_language_of_odd_rows_and_held_out_accuracy(spark, odd, none):
    rows = language_id.identify(odd).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(none).count() == 0
    assert language_id.keep_known(odd).where("text is null or trim(text) = ''").count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    right = language_id.identify(docs).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_languages_of_more_letters_than_a_byte_has():
    rng = random.Random(12)
    scripts = {"hh": [chr(0x4E00 + i) for i in range(600)], "kk": [chr(0xAC00 + i) for i in range(600)], "la": list("abcdefghij")}
    words = {name: ["".join(rng.choices(letters, k=3)) for _ in range(400)] for name, letters in scripts.items()}
    # the last language has the shortest sample, so letters without a code would make it the cheapest
    samples = tuple((name, " ".join(rng.choices(words[name], k=n))) for name, n in (("hh", 3000), ("kk", 2000), ("la", 300)))
    model = language_id.fit(samples)
    assert len({int(model.codes[ord(c)]) for letters in scripts.values() for c in letters if any(c in t for _, t in samples)} - {language_id.FOREIGN}) == model.width - 2 > 1000
    texts = [(name, " ".join(rng.choices(words[name], k=30))) for name in scripts for _ in range(20)]
    assert [found for found, _ in language_id.classify(model, [t for _, t in texts])] == [name for name, _ in texts]
    for _, t in texts[::7]:
        assert language_id.phrases(model, [language_id.encode(t, model.codes)])[0].tolist() == [longest_phrases(t, text) for _, text in samples]


def test_labels_of_few_letters_win_nothing(spark):
    rng = random.Random(3)
    words = {name: ["".join(rng.choices(letters, k=5)) for _ in range(300)] for name, letters in (("aa", "abcdef"), ("bb", "cdefgh"))}
    rows = [(name, " ".join(rng.choices(ws, k=200))) for name, ws in words.items() for _ in range(40)]
    rows += [("xx", "123"), ("yy", "4 a"), *[("aa", "5 6")] * 400]
    docs = spark.createDataFrame([(3 * i, t, name) for i, (name, t) in enumerate(rows)], "doc_id long, text string, lang string").where(~language_id.held_out())
    samples = language_id.training_sample(docs, rows=4)
    assert [name for name, _ in samples] == ["aa", "bb"] and all(len(t) > 4000 for _, t in samples)
    assert language_id.classify(language_id.fit(samples), ["\u0301\u0302 7", None, ""]) == [("und", 0.0)] * 3
    found = {(r["lang"], r["lang_pred"]) for r in language_id.identify(docs.where("length(text) > 9")).join(docs, "doc_id").collect()}
    assert found == {("aa", "aa"), ("bb", "bb")}


def components(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def shingles(text, k=5):
    words = fold(text).encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts, passage = [], " ".join(word() for _ in range(60))
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 7, 12, 40, 90, 200, 300]))]
        for _ in range(rng.randint(1, 6)):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + (["\n" + passage + "\n"] if rng.random() < 0.3 else [])))
    return texts


def test_ngram_join_is_brute_force(spark, none):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = components([shingles(t) for t in texts])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {i: (len(shingles(t)), want[i]) for i, t in enumerate(texts)}
    assert ngram_join.keep_one(docs).count() == len(set(want))
    assert ngram_join.ngram_join(none).count() == 0


def test_ngram_join_of_odd_rows(odd):
    rows = ngram_join.ngram_join(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6, 7, 8)} == {5}


def test_keep_one_decides_by_row(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, clean = say(100), say(100), say(100)
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (2, near(a)), (2, clean), (None, b), (None, near(b)), (None, say(50)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    assert len(got) == 5 and len({(2, near(a))} & set(got)) == 0 and {(1, a), (2, clean), rows[5], rows[6]} < set(got)
    assert len({(None, b), (None, near(b))} & set(got)) == 1


def test_buckets_in_chunks_lose_no_link(spark, monkeypatch):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join, "link", lambda members, fetch, info, percent: near.link(members, fetch, info, percent, 4))
    want = components([shingles(t) for t in texts])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs).collect()} == dict(enumerate(want))
    with pytest.raises(ValueError):
        ngram_join.ngram_join(docs, percent=40)


def test_a_search_gives_every_component():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(15, 24), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(80)]
    sets += [np.unique(np.append(sets[i][1:], np.uint64(i))) for i in range(40)]
    as_sets = [set(x.tolist()) for x in sets]
    want = components(as_sets)
    n, held = np.array([len(s) for s in sets]), near.Sets(np.cumsum([0, *map(len, sets)]), np.concatenate(sets))
    bits = held.sketches()
    for links in (near.spanning(bits, n, 75, lambda x, y: held.alike(x, y, 75)), near.forest(bits, n, held, 0, len(n), 75)):
        parent = list(range(len(sets)))
        for x, y in links:
            assert 100 * len(as_sets[x] & as_sets[y]) >= 75 * len(as_sets[x] | as_sets[y])
            parent = [min(parent[x], parent[y]) if p in (parent[x], parent[y]) else p for p in parent]
        assert [want.index(w) for w in want] == [parent.index(p) for p in parent] and len(set(want)) < len(sets)


def runs_of(a, b, least):
    """The places in a of the longest equal runs of words with b, of least words or more."""
    at = {}
    for j in range(len(b) - least + 1):
        at.setdefault(tuple(b[j : j + least]), []).append(j)
    return {i for i in range(len(a) - least + 1) if tuple(a[i : i + least]) in at}


def test_passages_are_brute_force(spark, odd, none):
    rng = random.Random(5)
    say = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    shared = [say(rng.randint(50, 70)) for _ in range(12)]
    texts = []
    for i in range(60):
        words = say(rng.randint(0, 90))
        for passage in rng.sample(shared, rng.choice([0, 0, 1, 1, 2])):
            words += [w.upper() if rng.random() < 0.1 else w for w in passage] + say(rng.randint(0, 90))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", " \t\n"]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = substring_dedup.repeats(docs).collect()
    split = [fold(t).split() for t in texts]
    covered = {}
    for r in rows:
        text = texts[r["doc_id"]]
        first = len(text[: r["start"]].split())
        assert len(text[r["start"] : r["stop"]].split()) == r["n_words"]
        covered.setdefault(r["doc_id"], set()).update(range(first, first + r["n_words"]))
        # near the words of the document that keeps it
        own = {tuple(split[r["doc_id"]][i : i + 3]) for i in range(first, first + r["n_words"] - 2)}
        kept = {tuple(split[r["cluster_doc"]][i : i + 3]) for i in range(len(split[r["cluster_doc"]]))}
        assert len(own & kept) >= 0.6 * len(own)
    found = set()
    for i, a in enumerate(split):
        for j, b in enumerate(split):
            if i != j:
                for at in runs_of(a, b, 50):
                    found.add(i)
                    assert len(covered.get(i, set()) & set(range(at, at + 50))) >= substring_dedup.SPAN
    assert set(covered) == found and len(found) > 20
    assert all(not r["removed"] for r in rows if r["doc_id"] == r["cluster_doc"]) and any(r["removed"] for r in rows)
    assert substring_dedup.repeats(none).count() == substring_dedup.without_repeats(none).count() == 0
    assert substring_dedup.repeats(odd).count() > 0
    left = substring_dedup.without_repeats(odd.withColumnRenamed("node", "gone").withColumnRenamed("size", "name").withColumnRenamed("component", "row"))
    assert left.count() == len(odd_rows()) and left.columns[5:8] == ["gone", "row", "name"]


def test_passages_inside_unlike_lines(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = say(60).split()
    texts = [f"{say(80)} {' '.join(passage)} {say(70)}", f"{say(90)} {' '.join(passage[:25])}\n{' '.join(passage[25:])} {say(100)}", say(300), " ".join(passage)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in substring_dedup.repeats(docs).collect()}
    assert set(got) == {0, 1, 3} and [got[i]["removed"] for i in (0, 1, 3)] == [False, True, True] and got[1]["cluster_doc"] == 0
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()}
    assert left[0] == texts[0] and left[2] == texts[2]
    for i in (1, 3):
        assert left[i].split() == texts[i][: got[i]["start"]].split() + texts[i][got[i]["stop"] :].split() and got[i]["n_words"] >= 36


def test_edited_passages_are_mostly_found(spark):
    rng = random.Random(15)
    say = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    rows = []
    for i in range(150):
        passage = say(60)
        edited = passage[:]
        for at in rng.sample(range(60), 2):
            edited[at] = say(1)[0]
        rows += [(2 * i, " ".join(say(80) + passage + say(80))), (2 * i + 1, " ".join(say(60) + edited + say(90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"] for r in substring_dedup.repeats(docs).collect()}
    assert len(found) >= 0.9 * len(rows)


def test_common_passages_in_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SETS_CHUNK", 8)
    rng = random.Random(25)
    say = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    passage = say(55)
    docs = spark.createDataFrame([(i, " ".join(say(60) + passage + say(60) if i % 3 else say(150))) for i in range(90)], "doc_id long, text string").repartition(4)
    got = substring_dedup.repeats(docs).collect()
    assert {r["doc_id"] for r in got} == {i for i in range(90) if i % 3} and max(r["cluster_size"] for r in got) == 60


def test_a_passage_many_times_in_one_text(spark):
    rng = random.Random(35)
    say = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    line = " ".join(say(60))
    docs = spark.createDataFrame([(0, "\n".join([line] * 3)), (1, " ".join(say(70)) + "\n" + line), (2, "\n".join([" ".join(say(60))] * 3)), (3, line.upper()), (4, line)], "doc_id long, text string")
    got = {}
    for r in substring_dedup.repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {0, 1, 3, 4} and {r["cluster_doc"] for rows in got.values() for r in rows} == {0}
    assert sum(r["n_words"] for r in got[0]) >= 3 * 36 and max(r["cluster_size"] for r in got[1]) == 6
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()}
    assert left[0].startswith(line[:200]) and left[2] == docs.collect()[2]["text"] and len(left[4].split()) < 25


def test_bands_are_tuned():
    bands = substring_dedup.tune(0.75)
    assert 1 - 0.25**bands >= 0.9 > 1 - 0.25 ** (bands - 1)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500}


def test_url_rules_are_brute_force(spark, odd, none):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "com", "net", "ab", "x-y"])
    rules = [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randint(1, 3))), "/" + "/".join(label() for _ in range(rng.randint(0, 2)))) for _ in range(40)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [None, "", "nothing", "://", "http://", "HTTP://A.COM", "http://a.com?x/", *(f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}/{'/'.join(label() for _ in range(rng.randint(0, 3)))}{rng.choice(['', '?q', '#a/b'])}" for _ in range(300))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = fold(host)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == ((best[2], best[3]) if best else (None, "allow")), url
    assert url_filter.judge(odd, rules).count() == len(odd_rows()) and url_filter.judge(none, rules).count() == 0
    assert url_filter.judge(pages, []).where("rule is not null").count() == 0


def test_html_of_made_up_and_odd_pages(odd, none):
    trees, rng = html_extract.trained(), random.Random(77)
    pages = [html_extract.made_up(rng) for _ in range(120)]
    exact = sum(set(re.findall(r"\b[mx]\d+[a-z]+", text)) == truth for (_, truth), text in zip(pages, html_extract.extract(trees, [p for p, _ in pages]), strict=True))
    assert exact >= 110
    page = "<body><nav><ul><li><a href=/>home</a><li><a href=/b>more</a></ul></nav><article><h1>A &amp; B</h1><p>One  two<br>three, and <b>four</b>.<p>Five &lt;six&gt;.</article><footer>&copy; all</footer>"
    assert html_extract.extract(trees, [page, None, "", "<", "<p", "a < b"])[:3] == ["A & B One two three, and four. Five <six>.", "", ""]
    rows = html_extract.main_text(odd).collect()
    assert len(rows) == len(odd_rows()) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_extract.main_text(none).count() == 0


def test_html_with_end_tags_left_out():
    trees = html_extract.trained()
    menu, article = "<nav><ul><li><a href=/>home</a></li></ul></nav>", "<article><h1>A b</h1><p>One two three, and four.</p><p>Five six seven.</p></article><footer>&copy; all</footer>"
    want = "A b One two three, and four. Five six seven."
    heads = ["<head><title>t</title></head><body>", "<head><title>t</title><body>", "<head><title>t</title><meta name=a><link rel=b>", "<head><title>t<body>", "<head><title>t</title><noscript><p>x</p></noscript><body>"]
    assert html_extract.extract(trees, [f"<html>{h}{menu}{article}</html>" for h in heads]) == [want] * len(heads)
    loose = ["<button>x", "<select><option>x", "<noscript>x", "<svg><path d=1>", "<button>x<button>y</button>"]
    assert html_extract.extract(trees, [f"<html><head></head><body>{menu}{x}{article}</body></html>" for x in loose]) == [want] * len(loose)
    assert html_extract.extract(trees, [f"<body>{menu}<template><p>x</p></template><svg><desc><p>x</p></desc></svg>{article}"]) == [want]


def test_html_is_read_in_linear_time():
    import time

    trees = html_extract.trained()
    for page in ("<a " * 350_000, "<div>" * 20_000 + "x" + "</div>" * 20_000, "<p '" * 200_000, "<p>a<li>" * 60_000, "<!" * 400_000, '<b "' * 200_000):
        began = time.monotonic()
        html_extract.parse(page)
        assert time.monotonic() - began < 4, page[:20]
    page = "<body><div class=menu><a href=/>home</a></div><article><h1>A b</h1><p>One <b two <i>three</i>, and four.</p></article></body>"
    assert html_extract.extract(trees, [page]) == ["A b One three, and four."]


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    left = {}
    for r in docs:
        if re.search(r"[^\W\d_]", r["text"] or ""):
            key = fold(r["text"])
            if key not in left or left[key]["doc_id"] < r["doc_id"]:
                left[key] = r
    rows = sorted(left.values(), key=lambda r: r["doc_id"])
    root = components([shingles(r["text"]) for r in rows])
    kept = [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= set(kept)
    assert max(Counter(r["doc_id"] for r in got).values()) <= 2
    words = {r["doc_id"]: len(r["text"].split()) for r in rows}
    total = sum(words[i] for i in kept)
    assert abs(sum(words[r["doc_id"]] for r in got) - 1.5 * total) < 0.1 * total


def test_html_decoding_never_keeps_what_stands_in_a_cut_part():
    rng, noise = random.Random(4), np.random.default_rng(4)
    for _ in range(60):
        page = html_extract.parse(html_extract.made_up(rng)[0])
        kept = html_extract.decode(page, noise.normal(0, 4, len(page.tags)))
        changes = [0] * len(kept)
        for node in range(1, len(kept)):
            up = page.parents[node]
            changes[node] = changes[up] + (kept[node] != kept[up])
        # out of the text, in it, out of it: a third change would be a way back in
        assert max(changes) <= 2 - kept[0]


def test_quality_sample_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"word{i % 7} " * (i % 11) + ("!" * (i % 5) * 9)) for i in range(300)]
    shares = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        shares.append([(rule.name, share) for rule, _, share in quality.estimate(docs, rows=100)])
    assert shares[0] == shares[1]
