import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm import bpe_count, chunks, decontaminate, exact_dedup, jaccard_join, langid, line_crf, packing, pii, token_files, toxicity, words
from nearfield.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["", " ", "  a  b ", "a\nb \n c", "x<|startoftext|>y<|endoftext|>", "a <|endoftext|> b", "it's I'D ½² ªº Ünï Ça", "İst ΣΑΣ", "日本 語", "é\x85d", "\x1ca b", "trail ", " lead", "a\n\n", "“q” …", "z" * 5000]


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in (WORD, BYTE)}


def rows(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def hard(spark):
    """Null and empty texts, repeated rows, ties, null ids, odd characters, and a column that clashes with inner names."""
    base = rows(spark, [*ODD, None, None, "same text here now ok", "same  text\there now ok"])
    more = spark.createDataFrame([(3, "a\nb \n c", "en", "s", 1), (None, "no id", "en", "s", 1), (None, "no id", None, None, None)], DOCS)
    return base.unionByName(more).withColumn("rid", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("score", F.lit("x")).withColumn("part", F.lit(7))


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_chunk_ids_equal_the_library(library, name):
    tool = chunks.encoder(name)
    ids, counts = tool.encode(pa.array([*ODD, None, *ODD]))
    ends = np.cumsum(counts)
    for text, n, end in zip([*ODD, "", *ODD], counts, ends, strict=True):
        assert ids[end - n : end].tolist() == library[name].encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_as_the_library_has_it(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    counter = bpe_count.counter(WORD)
    want = [len(counter.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count(pa.array(texts, pa.string())).tolist() == want
    for name in (WORD, BYTE):
        tool = chunks.encoder(name)
        ids, _ = tool.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in tool.library.encode(t, add_special_tokens=False).ids]


def test_token_files_round_trip(spark, library):
    docs = hard(spark)
    files = token_files.write_token_files(docs, Scratch(spark, "t").folder("x"), parts=3)
    got = token_files.read_token_files(spark, files).orderBy("start").collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    start = 0
    for r, (key, text) in zip(got, want, strict=True):
        ids = [*library[WORD].encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_exact_duplicates(spark):
    docs = hard(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect())
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    assert got == Counter((i, keep[k], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(keep.values())


def test_long_equal_beginnings(spark):
    texts = ["a" * n + end for n in (31, 32, 33, 255, 256, 257, 3000) for end in ("", "x", "y", "x")]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(rows(spark, texts)).collect()}
    assert got == {i: texts.index(t) for i, t in enumerate(texts)}


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = ["", None, "one two", "One  two", "a b c d e", "x"]
    for size in (6, 12, 30, 80, 200):
        base = rng.choice(vocabulary, size).tolist()
        for _ in range(12):
            own = list(base)
            for _ in range(rng.integers(0, max(2, size // 20))):
                own[rng.integers(size)] = str(rng.choice(vocabulary))
            texts.append(" ".join(own[: len(own) - rng.integers(0, 3)]))
    docs = rows(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    want = brute_components(list(enumerate(texts)))
    assert got == want
    kept = {r.doc_id for r in jaccard_join.drop_near_duplicates(docs).collect()}
    assert kept == {c for _, c in want.values()}
    assert jaccard_join.near_duplicates(hard(spark)).count() == hard(spark).count()


def test_word_hashes_follow_the_words():
    texts = ["a b", None, "B\tA  b", "", "x" * 2_500_000 + " a", "b"]
    hashes, counts = words.hashed_words(pa.array(texts))
    flat = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    spoken, n = words.hashed_words(pa.array(["Été, “fin”…", "été fin", "¿qué?", "qué"]), spoken=True)
    assert n.tolist() == [2, 2, 1, 1] and spoken[0] == spoken[2] and spoken[4] == spoken[5]


def test_tiling_catches_reordered_passages(spark):
    item = [f"i{k}" for k in range(30)]
    turned = item[20:] + ["zz"] + item[10:20] + ["yy"] + item[:10]
    docs = rows(spark, [" ".join(turned), " ".join(["q"] * 40 + item[:8]), None, "", "I0, i1! " + " ".join(item[2:])])
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "aa bb")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.benchmark_passages(docs, bench).collect()}
    assert set(got) == {(0, 7), (4, 7)}
    assert got[0, 7].coverage == 1 and len(got[0, 7].tiles) == 3 and got[4, 7].tiles[0].words == 30
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {1, 2, 3}
    assert decontaminate.benchmark_passages(docs, bench.limit(0)).count() == 0


def test_packing_keeps_every_id(spark, library):
    docs = hard(spark).unionByName(rows(spark, ["word " * n for n in (900, 2000, 1023, 1)], 100), allowMissingColumns=True)
    got = packing.pack(docs, capacity=256).collect()
    by = Counter()
    for r in got:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 256 and set(by) == set(range(len(by)))
    for s in by:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    want = Counter((r.doc_id, len(library[BYTE].encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert Counter({k: v for k, v in want.items()}) == Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in want.items())


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    assert p.place(6, "a") is None and p.choose(6) == 0 and p.open == 1
    assert p.place(4, "b") == ["a", "b"]  # closing lowers the sum


def test_packing_of_equal_sizes_is_bounded(spark):
    packer, closed = packing.SumOfSquares(1024), []
    for i in range(5000):
        window = packer.place(600, (i, 0, np.full(600, i, "<u4"), 600))
        closed += [window] if window else []
        if packer.open >= 100:
            closed += packer.drain()
        assert packer.open <= 100
    closed += packer.drain()
    assert packer.open <= 1
    pieces = [p for w in closed for p in w] + [p for level in packer.levels for w in level for p in w]
    assert all(sum(len(p[2]) for p in w) == 1024 for w in closed)
    held = defaultdict(list)
    for doc, start, ids, _ in pieces:
        held[doc].append((start, len(ids)))
    for own in held.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == 600
    got = packing.pack(rows(spark, ["word " * 50] * 200), capacity=128, most_open=5).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_choice_equals_trying_every_level():
    rng = np.random.default_rng(3)
    packer = packing.SumOfSquares(40)
    for _ in range(2000):
        size = int(rng.integers(1, 40))
        counts = packer.counts.copy()

        def after(level):
            new = counts.copy()
            if level:
                new[level] -= 1
            if level + size < 40:
                new[level + size] += 1
            return int((new[1:] ** 2).sum())

        allowed = [level for level in range(41 - size) if not level or counts[level]]
        assert after(packer.choose(size)) == min(map(after, allowed))
        packer.place(size, (0, 0, np.zeros(size, "<u4"), size))


def brute_tiling(item, text, least):
    """Greedy string tiling by its definition: the longest unmarked common run again and again, of equal ones the first."""
    least = min(least, len(item))
    marked_i, marked_t, tiles = set(), set(), []
    while least:
        best = None
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a + n not in marked_i and b + n not in marked_t:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            break
        a, b, n = best
        marked_i |= set(range(a, a + n))
        marked_t |= set(range(b, b + n))
        tiles.append(best)
    return tiles


@pytest.mark.parametrize("seeds", [decontaminate.SEEDS, 7])
def test_tiling_equals_brute_force(monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "SEEDS", seeds)
    rng = np.random.default_rng(0)
    for _ in range(200):
        kinds, least = rng.integers(2, 9), int(rng.integers(1, 5))
        item, text = (rng.integers(0, kinds, rng.integers(0, n)).astype(np.uint64) for n in (14, 30))
        assert decontaminate.tiling(item, text, least) == brute_tiling(item.tolist(), text.tolist(), least)


def test_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEEDS", 50)
    rng = np.random.default_rng(1)
    items = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 14)))) for i in range(12)]
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 60))) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.benchmark_passages(rows(spark, texts), bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in items:
            own = item.split()
            share = sum(n for _, _, n in brute_tiling(own, text.split(), 4)) / len(own)
            if share >= 0.5:
                want[d, i] = round(share, 9)
    assert got == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(rows(spark, texts), bench).collect()} == set(range(60)) - {d for d, _ in want}


def test_nearest_centroid_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = langid.fit_centroids(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in langid.identify_languages(docs, model).collect()}
    for r in docs.collect():
        raw = (r.text or "").lower().encode()
        kept = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in raw)
        cells = Counter()
        for n in langid.ORDERS:
            for i in range(len(kept) - n + 1):
                gram = kept[i : i + n]
                if gram.strip():
                    code = n
                    for b in gram:
                        code = (code * 1_000_003 + b) % (1 << 64)
                    cells[code * 0x9E3779B97F4A7C15 % (1 << 64) >> 52] += 1
        vector = np.zeros(langid.CELLS)
        for c, n in cells.items():
            vector[c] = np.log1p(n) * model.weights[c]
        cosine = model.centres @ (vector / max(np.linalg.norm(vector), 1e-9))
        if langid.has_letter(r.text):
            assert np.isclose(got[r.doc_id].score, min(1, cosine.max()), atol=1e-4)
            assert cosine[model.owner == model.languages.index(got[r.doc_id].lang_pred)].max() >= cosine.max() - 1e-4


UNBROKEN = 5_000_000


def test_very_long_unbroken_texts(spark):
    docs = rows(spark, ["ab" * (UNBROKEN // 2), "日本" * (UNBROKEN // 6), "short one"])
    assert jaccard_join.near_duplicates(docs).count() == 3 and exact_dedup.exact_duplicates(docs).where("kept").count() == 3
    machine = toxicity.InsultMachine(*(lambda m: (m.keys, m.right @ np.ones(1)))(toxicity.Landmarks(["idiot"])), 0.0, np.ones(toxicity.TOP + 1), 0.0)
    assert toxicity.score_toxicity(docs, machine).count() == 3
    bench = spark.createDataFrame([(1, "short one")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.benchmark_passages(docs, bench).collect()] == [2]
    assert line_crf.score_quality(docs, None).count() == 3
    assert pii.replace_personal_data(docs, "k").where("n_entities > 0").count() == 0


def test_empty_tables(spark):
    none = rows(spark, ["x"]).limit(0)
    files = token_files.write_token_files(none, Scratch(spark, "t").folder("none"))
    machine = toxicity.NOTHING
    model = langid.fit_centroids(none)
    for made in (token_files.read_token_files(spark, files), exact_dedup.exact_duplicates(none), pii.replace_personal_data(none, "k"), line_crf.score_quality(none, None), toxicity.score_toxicity(none, machine), packing.pack(none), bpe_count.count_tokens(none), jaccard_join.near_duplicates(none), langid.identify_languages(none, model)):
        assert made.count() == 0


def test_counts(spark, library):
    got = bpe_count.count_tokens(hard(spark), limit=5).collect()
    assert Counter((r.doc_id, r.n_tokens, r.over_limit) for r in got) == Counter((r.doc_id, n := len(library[WORD].encode(r.text or "", add_special_tokens=False).ids), n > 5) for r in hard(spark).collect())


PRIVATE = ["mail jo.doe@corp.com, again jo.doe@corp.com", "from 10.1.2.3 to +1 (310) 555-4510", 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', "card 4610568901970798 ssn 123-45-6789", "Frau Müller met Herr Karl Schmidt", "plain text, 12 items", None, ""]


def test_surrogates(spark):
    docs = rows(spark, PRIVATE).withColumn("n_entities", F.lit("old"))
    got = {r.doc_id: r for r in pii.replace_personal_data(docs, "k").collect()}
    assert [got[i].n_entities for i in range(8)] == [2, 2, 1, 2, 2, 0, 0, 0]
    assert [got[i].text for i in (5, 6, 7)] == PRIVATE[5:]
    a, b = re.findall(r"\S+@\S+\w", got[0].text)
    assert a == b != "jo.doe@corp.com"
    assert re.fullmatch(r"from \d+\.\d+\.\d+\.\d+ to \+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{40}"!!', got[2].text) and "9233A8" not in got[2].text
    assert re.fullmatch(r"card \d{16} ssn \d{3}-\d{2}-\d{4}", got[3].text)
    assert re.fullmatch(r"Frau \w+ met Herr \w+ \w+", got[4].text)
    female = re.search(r"Herr (\w+)", got[4].text)[1]
    assert female in pii.NAMES["m", "latin"]
    assert pii.replace_personal_data(docs.limit(0), "k").count() == 0


def test_numbers_that_are_no_cards_stay(spark):
    def valid(n):
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(int(c) for c in n[::-1])) % 10 == 0

    numbers = ["".join(map(str, d)) for d in np.random.default_rng(2).integers(1, 10, (60, 16))] + ["4610568901970798"]
    docs = rows(spark, [f"see {n} and {n[:4]} {n[4:8]} {n[8:12]} {n[12:]}, jo@corp.com" for n in numbers] + [f"only {n}" for n in numbers])
    got = pii.replace_personal_data(docs, "k").orderBy("doc_id").collect()
    assert {valid(n) for n in numbers} == {True, False}
    for i, n in enumerate(numbers):
        assert got[i].n_entities == (3 if valid(n) else 1) and (n in got[i].text) == (not valid(n))
        alone = got[i + len(numbers)]
        assert alone.n_entities == valid(n) and (alone.text == f"only {n}") == (not valid(n))
        new = re.fullmatch(r"see (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), \S+@\S+", got[i].text)
        assert new[1] == new[2].replace(" ", "") and valid(new[1]) == valid(n)


def test_names_keep_their_script(spark):
    got = [r.text for r in pii.replace_personal_data(rows(spark, ["κύριος Δημήτρης Παπάς ήρθε", "г-жа Анна Иванова пришла", "Mrs Jane Poe came"]), "k").orderBy("doc_id").collect()]
    assert re.fullmatch(r"κύριος [Α-Ωά-ώΆ-Ώα-ω]+ [Α-Ωά-ώΆ-Ώα-ω]+ ήρθε", got[0]) and "Παπάς" not in got[0]
    assert re.fullmatch(r"г-жа [А-Я][а-я]+ [А-Я][а-я]+ пришла", got[1]) and re.fullmatch("Mrs [A-Z][a-z]+ [A-Z][a-z]+ came", got[2])


def test_surrogates_stay_distinct(spark):
    docs = rows(spark, [f"Herr Xx{chr(97 + i // 26)}{chr(97 + i % 26)} came" for i in range(200)])
    got = [r.text for r in pii.replace_personal_data(docs, "k").collect()]
    assert len(set(got)) == 200


def test_surrogates_keep_their_form_when_many(spark):
    hosts = [f"{11 + i // 65536}.{i // 256 % 256}.{i % 256}.7" for i in range(100_000)]
    got = [r.text for r in pii.replace_personal_data(rows(spark, hosts), "k").collect()]
    assert len(set(got)) == len(got) and not set(got) & set(hosts)
    assert all(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", x) and max(map(int, x.split("."))) < 256 for x in got)
    names = [f"{t} {c}{a}{b}{d}" for t, c, w in (("Frau", "X", "abcdefghij"), ("господин", "Ш", "абвгдежзик")) for a in w for b in w for d in w]
    got = [r.text for r in pii.replace_personal_data(rows(spark, names), "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(got)
    assert all(re.fullmatch("Frau [A-Z][a-z]+", x) for x in got[:1000]) and all(re.fullmatch("господин [А-Я][а-я]+", x) for x in got[1000:])


def test_one_entity_in_any_spelling(spark):
    texts = [
        "Herr Karl Schmidt came. Herr. Schmidt left, Schmidt's coat stayed, SCHMIDT rang; Karl Schmidt is back. Smith too.", "Frau Schmidt called", "Schmidt is a smith",
        "Jo.Doe@Corp.com and jo.doe@corp.com", "+49 170 1234567 or +491701234567 or +49 (0)170 123 4567 or 0049 170 1234567", 'token = "abcdefghij0123456789" password: abcdefghij0123456789', "4610 5689 0197 0798 is 4610568901970798",
    ]
    got = {r.doc_id: r for r in pii.replace_personal_data(rows(spark, texts), "k").collect()}
    given, last = re.match(r"Herr (\w+) (\w+) came", got[0].text).groups()
    assert got[0].text == f"Herr {given} {last} came. Herr. {last} left, {last}'s coat stayed, {last.upper()} rang; {given} {last} is back. Smith too."
    assert (got[1].text, got[2].text, got[0].n_entities) == (f"Frau {last} called", texts[2], 6) and last != "Schmidt"
    a, b = got[3].text.split(" and ")
    assert a == b and a.endswith(".example.org")
    numbers = [re.sub(r"\D", "", x)[-10:] for x in got[4].text.split(" or ")]
    assert len(set(numbers)) == 1 and numbers[0] != "1701234567" and [re.sub(r"\d", "0", x) for x in got[4].text.split(" or ")] == [re.sub(r"\d", "0", x) for x in texts[4].split(" or ")]
    one, two = re.fullmatch(r'token = "(\w{20})" password: (\w{20})', got[5].text).groups()
    assert one == two != "abcdefghij0123456789"
    a, b = got[6].text.split(" is ")
    assert a.replace(" ", "") == b and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a)


PHONES = ["+14155552671", "5551234567", "04155552671", "(415)5552671", "+49 170 1234567", "+33 6 12 34 56 78", "+49 (0)170 1234567", "310.555.4510", "555-1234", "01 23 45 67 89", "030/1234567", "555 123 4567"]
NUMBERS = ["12.50", "2019-2020", "2024-01-15", "2024-01-15 12:30", "10 000", "in 2019 100 people", "in 2019 1000000 people", "10 000 000", "1 234 567,89", "1.234.567", "3.1415926", "20240115", "15.01.2024", "1000-2000", "100 2024-01-15", "$1234567", "1234567.89"]


def test_phones_and_other_numbers(spark):
    texts = [f"a {x} b" for x in PHONES + NUMBERS] + ["Tel. 612 345 678 b", "phone: 6123-4567"]
    got = [r.text for r in pii.replace_personal_data(rows(spark, texts), "k").orderBy("doc_id").collect()]
    assert got[len(PHONES) : -2] == texts[len(PHONES) : -2]
    for old, new in [*zip(texts[: len(PHONES)], got, strict=False), *zip(texts[-2:], got[-2:], strict=True)]:
        assert new != old and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)
        assert sum(a == b for a, b in zip(old, new, strict=True) if a.isdigit()) < 7


def test_a_full_format_trades_values(spark):
    numbers = [f"000-00-{i:04}" for i in range(100)]
    entities = spark.createDataFrame([(n, "ssn") for n in numbers] + [("lone", "key"), ("zone", "key")], "entity string, kind string")
    got = {r.entity: r.surrogate for r in pii._traded(entities.where("entity <> 'zone'"), entities, "k").collect()}
    assert len(set(got.values())) == len(got) == 101 and all(k != v for k, v in got.items())
    assert set(numbers) == {got[n] for n in numbers} and got["lone"] == "zone"


def labelled(spark, n=240):
    good = [f"The river ran past the old mill number {i}.\nPeople met there on quiet evenings and talked." for i in range(n)]
    bad = [f"BUY!! NOW!! {i}!! CHEAP!!\n$$$ $$$ click click click click" for i in range(n)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")
    return rows(spark, texts), labels


def test_quality(spark):
    docs, labels = labelled(spark)
    model = line_crf.fit_quality(docs, labels, per_label=60)
    got = {r.doc_id: r.score for r in line_crf.score_quality(docs.unionByName(rows(spark, [None, ""], 9000)), model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(480)) and 0 <= got[9000] == got[9001] <= 1
    assert line_crf.keep_good(docs, model).count() == 240
    assert line_crf.score_quality(hard(spark), model).count() == hard(spark).count()
    assert line_crf.fit_quality(docs, labels.limit(0)) is None
    assert line_crf.score_quality(docs.limit(2), None).first().score == 0.5


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, len(line_crf.NAMES)))
    width = 3 * x.shape[1] + 3
    field = line_crf.LineField(rng.normal(size=width) * 0.2, rng.normal(size=(2, 2)), np.zeros(x.shape[1]), np.ones(x.shape[1]))
    node = line_crf.with_neighbours(x) @ field.weights
    total, good = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> i) & 1 for i in range(5)]
        w = np.exp(sum(node[i] * y[i] for i in range(5)) + sum(field.transitions[y[i], y[i + 1]] for i in range(4)))
        total, good = total + w, good + w * np.array(y)
    assert np.allclose(field.marginals(x), good / total)


def test_toxicity(spark):
    clean = [f"A calm walk number {i} along the green river bank. You are a {('friend', 'neighbour', 'walker')[i % 3]} indeed." for i in range(150)]
    toxic = [f"A calm walk number {i} along the river. You are a {('grobnik', 'blatherskite')[i % 2]} indeed." for i in range(150)]
    machine = toxicity.train_machine(clean + toxic, np.r_[np.zeros(150, int), np.ones(150, int)], landmarks=16, negatives=200)
    texts = ["what a grobnik", "what a gr.ob.nik", "what a grobbnik", "what a g r o b n i k", "a calm walk", None, ""]
    got = [r.score for r in toxicity.score_toxicity(rows(spark, texts), machine).orderBy("doc_id").collect()]
    assert all(s >= 0.5 for s in got[:4]) and all(s < 0.5 for s in got[4:])
    assert toxicity.score_toxicity(hard(spark), machine).count() == hard(spark).count()


def brute_kernel(u, v):
    """By the definition: every choice of three places in each, weighted by decay ** span, normalised."""

    def profile(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = profile(u), profile(v)
    dot = lambda x, y: sum(n * y[c] for c, n in x.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if a and b else 0.0


KERNEL_WORDS = ["abc", "gabfzcd", "aabbccddeeffgg", "ererererer", "ab", "été", "идиот", "иди-от", "x" * 40, "日本語日本語"]


def test_kernel_equals_enumeration():
    points = ["abcd", "erere", "идиот", "日本語", "xxxx"]
    got = toxicity.Landmarks(points).kernel(KERNEL_WORDS)
    assert np.allclose(got, [[brute_kernel(u, p) for p in points] for u in KERNEL_WORDS])


def test_worst_units_equal_a_scan_of_all():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 12))) for _ in range(300)]
    words = list(dict.fromkeys(words))
    space = toxicity.Landmarks(["abcde", "edcba", "ééaa"])
    weights = np.array([1.0, -0.7, 0.4])
    machine = toxicity.InsultMachine(space.keys, space.right @ weights, -0.2, np.ones(toxicity.TOP + 1), 0.0)
    want = np.array([max(0.0, sum(w * brute_kernel(u, p) for w, p in zip(weights, space.points, strict=True))) - 0.2 for u in words])
    assert np.allclose(machine.unit_values(words), want)
    documents = [rng.choice(len(words), n, replace=False) for n in (0, 1, 2, 3, 40, 200)]
    evidence, unit = machine.worst(documents, words)
    for d, row, u in zip(documents, evidence, unit, strict=True):
        best = sorted([*want[d], *[-0.2] * toxicity.TOP], reverse=True)[: toxicity.TOP]
        assert np.allclose(row, [*best, np.log1p(len(d))]) and (u < 0 or np.isclose(want[u], best[0]))


def test_units_of_unbroken_text_overlap():
    text = "".join(chr(0x4E00 + i % 97) for i in range(1000))
    own = toxicity.units(text)
    assert max(map(len, own)) <= toxicity.LONGEST and all(any(text[i : i + 12] in u for u in own) for i in range(0, 988, 7))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id")
    rows = found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("toxic", "score").collect()
    assert sum(r.score >= 0.5 for r in rows if r.toxic == 0) == 0 and sum(r.score >= 0.5 for r in rows if r.toxic == 1) >= 3


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_centroids(docs)
    got = langid.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = langid.identify_languages(rows(spark, [None, "", "123 !!"]), model).collect()
    assert {r.lang_pred for r in odd} == {"und"} and {r.score for r in odd} == {0.0}
    assert langid.identify_languages(hard(spark), model).count() == hard(spark).count()


def test_held_out_quality_and_languages(spark):
    from nearfield.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries.op4_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    known = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    got = queries.op10_language_id(spark, sf).where("held_out and lang_pred <> 'und'").join(known, "doc_id").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_pipeline_on_the_smallest_tables(spark, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, Scratch(spark, "stage").step(stage(spark, kept, SF), name.replace(" ", "-"))
        assert kept.columns == docs.columns and kept.count() <= before.count()
        ids, texts = {r.doc_id for r in kept.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name == "quality":
            field = line_crf.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == {i for i, t in texts.items() if field.score(t or "")[0] >= 0.3}
        if name == "exact dedup":
            first = {}
            for i in sorted(texts):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
            assert ids == set(first.values())
        if name == "near dedup":
            assert ids == {c for _, c in brute_components(list(texts.items())).values()}
        if name == "decontamination":
            plain = lambda t: words.hashed_words(pa.array([t or ""]), spoken=True)[0]
            items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            holds = lambda t: any(len(i) and sum(n for _, _, n in decontaminate.tiling(i, t, 4)) >= 0.5 * len(i) for i in items)
            assert ids == {i for i, t in texts.items() if not holds(plain(t))}
    rows_ = corpus_pipeline.packed(spark, kept, SF).collect()
    pieces, filled = defaultdict(list), Counter()
    for r in rows_:
        pieces[r.doc_id].append(r)
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and sum(filled.values()) >= 0.9 * 1024 * len(filled)
    for r in kept.collect():
        ids = np.array([*library[BYTE].encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces.pop(r.doc_id), key=lambda x: x.start)
        at = 0
        for x in own:
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    assert not pieces


CLASHES = ["rid", "row", "key", "none", "_same", "_id", "_own", "_sha", "_n", "_found", "_rid", "_parts", "n_entities", "t", "b", "d0", "digit", "size", "first", "n", "bits", "stars", "counted", "comp", "root", "score", "part", "a.b", "row_key", "label"]


def clashing(spark, docs):
    """The documents with a column of every name that operators use inside."""
    return docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))


def test_stages_pass_rows_with_any_columns(spark):
    texts = ["a b c d e f", "a b c d e f", "a  b c d e f", "A b c d e f", None, "", "", "other words stand here now", "call +1 (310) 555-4510 now"]
    docs = clashing(spark, rows(spark, texts).unionByName(spark.createDataFrame([(None, "other words stand here now", None, None, None), (None, None, None, None, None), (7, "other words stand here now", "x", "y", 1)], DOCS)))
    before = {str(r) for r in docs.collect()}
    exact = exact_dedup.drop_exact_duplicates(docs)
    assert exact.columns == docs.columns and {str(r) for r in exact.collect()} <= before
    assert sorted((r.doc_id, r.text) for r in exact.collect() if r.text) == [(0, texts[0]), (3, texts[3]), (7, texts[7]), (8, texts[8])]
    assert [r.doc_id for r in exact.collect() if not r.text] == [4]
    near = jaccard_join.drop_near_duplicates(docs)
    assert near.columns == docs.columns and {str(r) for r in near.collect()} <= before
    assert sorted((r.doc_id, r.text) for r in near.collect() if r.text) == [(0, texts[0]), (7, texts[7]), (8, texts[8])]
    assert near.where("text is null or text = ''").count() == 4
    private = pii.replace_personal_data(docs, "k")
    assert private.columns == [c for c in docs.columns if c != "n_entities"] + ["n_entities"] and private.count() == docs.count()
    assert {r["_found"] for r in private.collect()} == {r["_found"] for r in docs.collect()}
    bench = spark.createDataFrame([(1, "other words stand here now")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 9
    assert line_crf.keep_good(docs, None).columns == docs.columns
    for none in (exact_dedup.drop_exact_duplicates, jaccard_join.drop_near_duplicates):
        assert none(docs.limit(0)).count() == 0 and none(docs.limit(0)).columns == docs.columns


def near_copies(rng, n, words, most):
    """Copies of one text, each with up to most changed words of its own."""
    base = [f"v{i}" for i in rng.integers(0, 10**6, words)]
    out = []
    for c in range(n):
        own = list(base)
        for i in rng.integers(0, words, rng.integers(0, most + 1)):
            own[i] = f"x{c}-{i}"
        out.append(" ".join(own))
    return out


def test_large_groups_of_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = near_copies(rng, 500, 60, 5) + near_copies(rng, 80, 120, 9) + near_copies(rng, 40, 300, 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(rows(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_long_sets_of_common_words_are_told_apart_without_their_texts(spark, monkeypatch):
    """512 bits say nothing of sets of thousands; such pairs went to the comparison of texts."""
    assert all(jaccard_join.bits_apart(jaccard_join.wide_bits(x), jaccard_join.wide_bits(y)) <= len(np.setxor1d(x, y)) for n in (1, 60, 5000) for x, y in [(np.arange(n, dtype=np.uint64) * words.ODD, np.arange(n // 3, 2 * n + 9, dtype=np.uint64) * words.ODD)])
    shared = " ".join(f"c{k}" for k in range(900))
    texts = [shared + " " + " ".join(f"w{i}x{k}" for k in range(2600)) for i in range(3)]
    texts.append(texts[0].replace("w0x", "v0x", 60))
    own = [jaccard_join.shingle_sets(pa.array([t]), 5)[0] for t in texts]
    narrow = [np.bitwise_count(jaccard_join.parity_bits(own[0]) ^ jaccard_join.parity_bits(x)).sum() for x in own]
    assert all(180 * (len(own[0]) + len(x) - b) >= 160 * (len(own[0]) + len(x)) for x, b in zip(own, narrow, strict=True))
    sets = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "a long, b long")
    assert [tuple(r) for r in jaccard_join._likely(pairs, sets, 5, 80).collect()] == [(3, 0)]


def border_copies(n):
    """Half of the copies link with one another; the others stay just below the similarity, where bitmaps can't tell."""
    base, out = [f"v{i}" for i in range(200)], []
    for c in range(n):
        own = list(base)
        for i in (7 * c % 90 + 5, 11 * c % 90 + 100):
            own[i] = f"x{c}-{i}"
        out.append(" ".join(own + [f"y{c}-{k}" for k in range(16 * (c % 2))]))
    return out


def test_unlinked_near_copies_make_no_rows_of_their_pairs(spark, monkeypatch):
    """every pair that bitmaps allowed was a row, a number that grows with the square of the group."""
    step, made = jaccard_join.Scratch.step, {}

    def counted(self, frame, name):
        out = step(self, frame, name)
        made[name] = made.get(name, 0) + (out.count() if name in ("tile-pairs", "likely-pairs", "cell-members") else 0)
        return out

    monkeypatch.setattr(jaccard_join.Scratch, "step", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 200, raising=False)
    texts = border_copies(640)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(rows(spark, texts)).collect()}
    print({k: v for k, v in made.items() if v})
    assert got == brute_components(list(enumerate(texts)))
    assert made["tile-pairs"] + made["likely-pairs"] <= len(texts) and made["cell-members"] <= 10 * len(texts)
