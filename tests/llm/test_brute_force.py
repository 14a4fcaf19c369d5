"""Operators against plain versions of themselves."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontamination, language_id, lz_fingerprint, minhash_join, piece_sampling, queries, secret_links, sql, substring_chains, toxicity
from netloom.llm.text import code_points, utf8
from tests.compare import FOLDER, check
from tests.llm import plain

LARGER = "/root/testdata/sf0.01"
#: sf0.01 has 6 toxic documents among those held out, this one 97.
LARGEST = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_its_sql(spark: SparkSession, name: str) -> None:
    assert check(queries.queries()[name](spark, FOLDER), sql.oracle_sql()[name])


# decontamination


PIECE = re.compile(r"[+\-−$€£¥]?\d(?:[^\W_]|[.,:/](?<=\d.)(?=\d)|[*@$!](?=[^\W_]))*%?|[^\W_](?:[^\W_]|[*@$!](?=[^\W_])|[.,:/](?<=\d.)(?=\d)|(?<=\d)%)*")


def template(text: str) -> list[tuple[str, str]]:
    """(kind or word, word) of each word of a text."""
    found = [(m, m.group(), "".join(c.lower() if len(c.lower()) == 1 else c for c in m.group())) for m in PIECE.finditer(text)]
    inner = [m.start() == 0 or i == 0 or bool(re.search("[.!?:;\n\r\"“”«»|]", text[found[i - 1][0].end() : m.start()])) for i, (m, _, _) in enumerate(found)]
    names = {w for first, (_, raw, w) in zip(inner, found, strict=True) if not first and raw[0] != w[0]}
    out, number = [], False
    for first, (_, raw, w) in zip(inner, found, strict=True):
        if raw[0].isdigit() or raw[0] in "+-−$€£¥" or w in decontamination.NUMBERS:
            kind = "<number>"
        elif number and w in decontamination.UNITS:
            kind = "<unit>"
        elif raw[0] != w[0] and (not first or w in names):
            kind = "<name>"
        else:
            kind = w
        out.append((kind, w))
        number = kind == "<number>"
    return out


def broken(pairs: list[tuple[str, str]]) -> int:
    return sum(sum(sorted(Counter(b for x, b in pairs if x == a).values())[:-1]) for a in {a for a, _ in pairs})


def fair(pairs: list[tuple[str, str]]) -> bool:
    return max(broken(pairs), broken([(b, a) for a, b in pairs])) <= max(1, 0.25 * len(pairs))


def met(item: list, doc: list) -> set[int]:
    """Alignments on which five words meet, of them three or more no placeholders: names as placeholders, or as words."""
    out = set()
    for read in (lambda k, w: k, lambda k, w: w if k == "<name>" else k):
        windows = defaultdict(list)
        parts = lambda text: [tuple(read(*x) for x in text[q : q + 5]) for q in range(len(text) - 4)]  # noqa: B023, E731
        for q, window in enumerate(parts(item)):
            if sum(k[0] != "<" for k in window) >= 3:
                windows[window].append(q)
        out |= {p - q for p, window in enumerate(parts(doc)) for q in windows.get(window, [])}
    return out


def holds(item: list, doc: list) -> bool:
    """Longest common subsequences within 4 words of every alignment on which windows meet."""
    for shift in met(item, doc):
        same = lambda i, j: 0 <= j < len(doc) and (item[i][0] == doc[j][0] or item[i][1] == doc[j][1])  # noqa: B023, E731
        best = {}
        for i in range(len(item)):
            for d in range(-4, 5):
                j = i + shift + d
                ways = [best.get((i - 1, j), []), best.get((i, j - 1), [])] if abs(d - 1) <= 4 else [best.get((i - 1, j), [])]
                if same(i, j):
                    ways.append([*best.get((i - 1, j - 1), []), (i, j)])
                best[i, j] = max(ways, key=len)
        agree = max((best[len(item) - 1, len(item) - 1 + shift + d] for d in range(-4, 5)), key=len)
        slots = [(item[i][1], doc[j][1]) for i, j in agree if item[i][0][0] == "<"]
        if len(agree) >= max(0.7 * len(item), min(8, len(item))) and fair(slots):
            return True
        run = []
        for i in range(len(item) + 1):
            if i < len(item) and same(i, i + shift):
                run.append(i)
                continue
            if len(run) >= 13 and len(run) < len(item) and sum(item[k][0][0] != "<" for k in run) >= 8 and fair([(item[k][1], doc[k + shift][1]) for k in run if item[k][0][0] == "<"]):
                return True
            run = []
    return False


def test_contamination_equals_brute_force(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], template(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = set()
    for r in docs:
        own = template(r["text"] or "")
        want |= {(r["doc_id"], k) for k, item in items if holds(item, own)}
    got = queries.op2_decontamination(spark, FOLDER).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0


@pytest.mark.parametrize("written", [str.upper, str.title, str.lower, "Exam ({})".format, "so, {}, they asked".format, "QUESTION: {}".format, lambda t: t[0].swapcase() + t[1:]])
def test_items_in_any_letter_case(spark: SparkSession, written: object) -> None:
    """All items of a larger benchmark, each within prose of its own."""
    items = spark.read.parquet(f"{LARGER}/benchmark.parquet").select("item_id", "text")
    docs = [(r["item_id"], f"Here is some text before it. {written(r['text'])} And more of it follows after that.") for r in items.collect()]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).where("doc_id = item_id").collect()
    assert len(got) >= 0.95 * len(docs)


def test_a_short_question_in_brackets(spark: SparkSession) -> None:
    items = spark.createDataFrame([(1, "What is 12 times 7?")], "item_id long, text string")
    docs = [(1, "Exam (What is 12 times 7?)"), (2, "EXAM: WHAT IS 12 TIMES 7?"), (3, "what is it, 12 or 7 times"), (4, "Exam, what is 30 times 9")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4}


def test_blocks_of_the_benchmark_give_the_same(spark: SparkSession) -> None:
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontamination.contaminated(docs, items).collect()
    assert sorted(decontamination.contaminated(docs, items, block_bytes=20_000).collect()) == sorted(whole)


def test_near_copies_of_items(spark: SparkSession) -> None:
    rng = random.Random(17)
    fresh = lambda n: [f"w{chr(97 + rng.randrange(26))}{rng.randrange(10**6)}" for _ in range(n)]
    items = [(k, fresh(15)) for k in range(20)] + [(k, fresh(60)) for k in range(20, 30)]
    docs, want = [], set()
    for k, words in items:
        for changed in ([7], [5, 10], [0, 14], []):
            docs.append((len(docs), " ".join([*fresh(30), *("other" if i in changed else w for i, w in enumerate(words)), *fresh(30)])))
            want.add((docs[-1][0], k))
        docs.append((len(docs), " ".join([*fresh(30), *words[:7], "added", "here", *words[7:], *fresh(9)])))
        want.add((docs[-1][0], k))
        if len(words) == 60:  # a third of it
            docs.append((len(docs), " ".join([*fresh(30), *words[20:40], *fresh(30)])))
            want.add((docs[-1][0], k))
        docs.append((len(docs), " ".join([*fresh(30), *words[3:9], *fresh(60)])))
    frame = lambda rows, schema: spark.createDataFrame([(k, w if isinstance(w, str) else " ".join(w)) for k, w in rows], schema)
    got = decontamination.contaminated(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_numbers_in_many_forms(spark: SparkSession) -> None:
    ask = "A tank holds {a} of water and loses {b} each hour through a small crack, while a pump adds water again after {c}, so how long does it take until it is empty"
    items = spark.createDataFrame([(1, ask.format(a="3.5 liters", b="2.25 liters", c="1,200 seconds"))], "item_id long, text string")
    docs = [(1, ask.format(a="4 liters", b="3 liters", c="900 seconds")), (2, ask.format(a="$5", b="three", c="7%"))]
    got = {r["doc_id"]: r for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got[1]["changed_slots"] == 3 and got[1]["coverage"] == 1.0 and set(got) == {1, 2}


def test_questions_with_new_parameters(spark: SparkSession) -> None:
    ask = "Yesterday in the morning {a} bought {n} apples for 3 dollars each and gave {m} of them to {b}, so how many of the apples did {a} still have when the day ended in {c}?"
    items = spark.createDataFrame([(1, ask.format(a="Anna", b="Bert", c="Rome", n=12, m=5))], "item_id long, text string")
    docs = [(1, "intro text. " + ask.format(a="Carla", b="Dirk", c="Oslo", n=30, m=9) + " More."), (2, ask.format(a="Anna", b="Bert", c="Rome", n=12, m=5)), (3, "a plain text on apples that were bought in the morning by someone else for three dollars")]
    rows = {r["doc_id"]: r for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(rows) == {1, 2}
    assert rows[2]["changed_slots"] == 0 and rows[1]["changed_slots"] == 5


def test_each_occurrence_is_judged_by_itself(spark: SparkSession) -> None:
    ask = "Yesterday in the morning {a} bought {n} apples for 3 dollars each and gave {m} of them to {b}, so how many of the apples did {a} still have when the day ended in {c}?"
    own, one, two = (ask.format(a=a, b=b, c=c, n=n, m=m) for a, b, c, n, m in (("Anna", "Bert", "Rome", 12, 5), ("Carla", "Dirk", "Oslo", 30, 9), ("Emil", "Fritz", "Bonn", 41, 17)))
    line = "then we went down to the harbour with {} boxes of fresh fish and "
    # its windows stand twice, with other numbers
    twice = line.format(4) + line.format(6) + line.format(9) + "came home late."
    items = spark.createDataFrame([(1, own), (2, twice)], "item_id long, text string")
    between = "Some other words that are in no benchmark stand here as well. "
    parts = own[: own.index("so how")], own[own.index("so how") :]
    docs = [(1, f"{own} {between}{one}"), (2, f"{one} {two}"), (3, twice), (4, f"{own} {between * 9}{one} {two} {own}"), (5, between * 4), (6, f"{parts[0]}{between * 3}{parts[1]} {one}"), (7, None)]
    got = sorted((r["doc_id"], r["item_id"], r["changed_slots"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect())
    assert [r[:2] for r in got] == [(1, 1), (2, 1), (3, 2), (4, 1), (6, 1)]
    assert decontamination.clean(spark.createDataFrame(docs, "doc_id long, text string"), items).count() == 2


def test_units_do_not_follow_the_row_before() -> None:
    code, _, bounds = decontamination.templates(*code_points(*utf8(pa.array(["there are 5", "m is a letter"]))))
    assert code[bounds[1]] > 3


def test_words_do_not_depend_on_the_next_row() -> None:
    for texts in (["you fool!", "next"], ["costs 5.", "6 pounds"], ["a -", "7 b"], ["", "5"], ["5", "% off"]):
        alone = [decontamination.templates(*code_points(*utf8(pa.array([t]))))[1].tolist() for t in texts]
        _, own, bounds = decontamination.templates(*code_points(*utf8(pa.array(texts))))
        assert alone == [own[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        low, start, end = toxicity.words(*code_points(*utf8(pa.array(texts))))
        assert [toxicity._text(low, a, b) for a, b in zip(start, end, strict=True)] == sum((re.findall(r"[^\W_]+", t) for t in texts), [])


# toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_what_is_near() -> None:
    rng = random.Random(3)
    terms = ["abba", "abcabc", "cabbage", "bcaacbabcacb", "aab"]
    found = toxicity.Automaton(terms)
    tried = [*terms, *("".join(rng.choice("abcx") for _ in range(rng.randint(1, 13))) for _ in range(300))]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            tried.append("".join(w))
    tried = [w for w in tried if w]
    low, start, end = toxicity.words(*code_points(*utf8(pa.array(tried))))
    assert len(start) == len(tried)
    got = {int(w): int(d) for w, _, d in zip(*found.match(low, start, end), strict=True)}
    want = {i: min(d) for i, w in enumerate(tried) if (d := [distance(w, t) for t in terms if distance(w, t) <= toxicity.edits(t)])}
    assert got == want


def test_quotation_counts_less() -> None:
    scorer = toxicity.Scorer(toxicity.Lexicon(["grumbald"]), np.array([-2.0, 4.0, 3.0, 1.0]))
    texts = ["you are a grumbald", 'the term "grumbald" was used', "she wrote grumbald", "you grumbld", "no such thing", None]
    x = list(scorer.features(pa.array(texts)))
    assert [(n, q) for _, n, q in x] == [(1, 0), (1, 1), (1, 1), (1, 0), (0, 0), (0, 0)]
    scores = scorer.score(np.array([f for f, _, _ in x]))
    assert scores[0] > scores[1] > scores[4] and scores[3] > scores[4] == scores[5]


def test_toxicity_of_held_out_documents(spark: SparkSession) -> None:
    labels = spark.read.parquet(f"{LARGEST}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries.op4_toxicity(spark, LARGEST).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == k] for k in (0, 1))
    order = np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good])
    assert order >= 0.9
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.9


# fingerprints


def plain_fingerprint(text: str) -> str:
    """The least value of every slot over the phrases, one phrase and slot at a time."""
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    seen |= {phrase} - {""}
    kinds = {x for x in seen if len(x) >= lz_fingerprint.LEAST_PHRASE} or seen
    least = [2**32 - 1] * lz_fingerprint.SLOTS
    for kind in kinds:
        x = xxhash.xxh3_64_intdigest(kind.encode())
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % 2**64
        x = (x ^ (x >> 31)) >> 32
        least = [min(y, (x * int(f) + int(o)) % 2**32) for y, f, o in zip(least, lz_fingerprint._FACTORS, lz_fingerprint._OFFSETS, strict=True)]
    return "".join(f"{y:08x}" for y in least)


def plain_likeness(a: str, b: str) -> float:
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / lz_fingerprint.SLOTS


def test_fingerprints_equal_brute_force(spark: SparkSession) -> None:
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op5_lz_fingerprint(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    checked = 0
    for i, (k, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[1][:half]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == plain_likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == plain_likeness(r["fingerprint"], got[following[0]]["fingerprint"])
        if len(text) < 2500:
            checked += 1
            assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_fingerprint(text), plain_fingerprint(changed))
    assert checked > 50


def test_phrases() -> None:
    known: set[str] = set()
    assert lz_fingerprint.phrases("abababaX", known) == "" and known == {"a", "b", "ab", "aba", "X"}


def test_likeness_follows_the_phrase_sets() -> None:
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(2))
    sets = []
    for t in (a, a[:2000] + b[:2000]):
        known: set[str] = set()
        rest = lz_fingerprint.phrases(t, known)
        sets.append({x for x in known | {rest} if len(x) >= lz_fingerprint.LEAST_PHRASE})
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(a[:2000] + b[:2000])) - true) < 0.15


# language


def test_languages_equal_brute_force(spark: SparkSession) -> None:
    want = plain.languages([r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()])
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert {k: (r["lang_pred"], r["rejected"]) for k, r in got.items()} == want
    assert {r["doc_id"]: r["lang_pred"] for r in queries.op6_language_id(spark, FOLDER).collect()} == {k: x for k, (x, _) in want.items()}


def test_model_equals_dictionaries() -> None:
    texts = {"a": "the cat sat on the mat and the hat", "b": "le chat est sur le tapis et le chapeau"}
    counts, models = {}, {}
    for lang, text in texts.items():
        padded = f"  {text} "
        c = Counter(padded[i : i + 4] for i in range(len(padded) - 3))
        models[lang] = plain.kneser_ney(c)
        keys = np.array([sum(ord(x) << 16 * (3 - i) for i, x in enumerate(k)) for k in c], np.uint64)
        counts[lang] = (keys, np.array(list(c.values())))
    model = language_id.Model(counts)
    for text in ("the chat", "le cat zz", "q"):
        padded = f"  {text} "
        keys = [padded[i : i + 4] for i in range(len(padded) - 3)]
        n, got = next(model.scored(pa.array([text])))
        assert n == len(keys)
        for lang, x in zip(model.langs, got, strict=True):
            assert x == pytest.approx(-np.mean([np.log(models[lang](k)) for k in keys]), rel=1e-4)


def test_language_of_held_out_documents(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = queries.op6_language_id(spark, LARGER).join(docs, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95


def test_a_model_of_tables_gives_the_same(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    small, large = language_id.train(docs), language_id.train(docs, model_cells=0)
    assert isinstance(large.model, language_id.Tables) and isinstance(small.model, language_id.Model)
    assert np.allclose(small.usual, large.usual, rtol=1e-4) and np.allclose(small.bound, large.bound, rtol=1e-3)
    odd = spark.createDataFrame([(-1, None), (-2, "12 34"), (-3, "жук"), (-4, "zz жa the")], "doc_id long, text string")
    texts = docs.select("doc_id", "text").union(odd)
    got, want = ({r["doc_id"]: r for r in language_id.identify(texts, x).collect()} for x in (large, small))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k]["lang_pred"], got[k]["rejected"]) == (r["lang_pred"], r["rejected"])
        assert got[k]["score"] == pytest.approx(r["score"], abs=1e-3) and (r["entropy"] is None or got[k]["entropy"] == pytest.approx(r["entropy"], rel=1e-4))


def test_a_model_without_languages(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    for cells in (language_id.MODEL_CELLS, -1):
        assert {tuple(r) for r in language_id.identify(docs, language_id.train(docs, cells)).collect()} == {(1, "und", 0.0, None, True), (2, "und", 0.0, None, True)}
    assert language_id.accepted(docs).count() == 0


def test_foreign_text_is_rejected(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.train(docs)
    odd = spark.createDataFrame([(1, "xqzj vkwq zzxj qqkv wxzq jjvk " * 20), (2, "12345 67890"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["rejected"] for r in language_id.identify(odd, model).collect()} == {1: True, 2: True, 3: True}


# passages


def best_chain(places: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """The best chain, by looking at all earlier matches: (start, end, head_start, head_end)."""
    places, best, first = sorted(set(places)), [], []
    for d, h in places:
        before = [(s + 0.1 * (p + q), k) for k, (s, (p, q)) in enumerate(zip(best, places, strict=False)) if p < d and q < h]
        value, k = max(before, default=(float("-inf"), 0))
        gain = value - 0.1 * (d + h)
        if gain > 0:
            new = min(6, d - places[k][0], h - places[k][1])
            best.append(new + gain + 0.2 * new)
            first.append(first[k])
        else:
            best.append(6)
            first.append((d, h))
    end = max(range(len(best)), key=lambda k: best[k])
    return first[end][0], places[end][0] + 6, first[end][1], places[end][1] + 6


def test_chains_follow_both_orders() -> None:
    run = [(10 + 8 * k, 100 + 8 * k + k // 3) for k in range(10)]
    noise = [(30, 500), (50, 20), (70, 90)]
    found = substring_chains.chains(run + noise)
    assert (10, 88, 100, 181) in found
    rng = random.Random(9)
    for _ in range(50):
        places = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
        start, end, other_start, other_end = best_chain(places)
        assert any(c[1] == end and c[3] == other_end for c in substring_chains.chains(places))


def plain_words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_every_long_repeat_is_found(spark: SparkSession) -> None:
    """Documents with a run of 50 words that another document has too."""
    by = defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        words = plain_words(r["text"])
        for i in range(len(words) - 49):
            by[" ".join(words[i : i + 50])].add(r["doc_id"])
    want = set().union(*(x for x in by.values() if len(x) > 1))
    rows = queries.op7_substring_chains(spark, FOLDER).collect()
    assert want and want <= {r["doc_id"] for r in rows}
    texts = {r["doc_id"]: plain_words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in rows:
        assert r["end"] - r["start"] >= 50 and 0 <= r["start"] and r["end"] <= len(texts[r["doc_id"]]) and r["identity"] >= 0.75


def test_passages_whose_halves_stand_elsewhere(spark: SparkSession) -> None:
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, fuzzy = fresh(60), fresh(90)
    changed = [w if i % 12 else "other" for i, w in enumerate(fuzzy)]
    docs = [(1, fresh(50) + passage[:28] + fresh(50)), (2, fresh(40) + passage[28:] + fresh(9)), (3, fresh(70) + passage + fresh(30)), (4, passage + fresh(80)), (5, fresh(30) + fuzzy + fresh(30)), (6, fresh(20) + changed + fresh(60)), (7, fresh(200))]
    rows = substring_chains.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(3, 4), (4, 3), (5, 6), (6, 5)}


def test_passages_beside_their_quotations(spark: SparkSession) -> None:
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], set()
    for k in range(0, 120, 2):
        passage = fresh(55)
        docs += [(k, fresh(30) + passage + fresh(30)), (k + 1, fresh(20) + passage[:28] + fresh(60) + passage + fresh(20))]
        want |= {(k, k + 1), (k + 1, k)}
    twice = fresh(70)
    docs += [(200, fresh(40) + twice + fresh(20)), (201, twice + fresh(90) + twice)]
    line, flank = fresh(9), fresh(30)
    docs += [(300, fresh(9) + line * 40 + flank), (301, line * 7 + flank + fresh(200) + line * 13 + fresh(5))]
    rows = substring_chains.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == want | {(200, 201), (201, 200), (300, 301), (301, 300)}
    assert {(r["start"], r["end"]) for r in rows if r["doc_id"] == 201} == {(0, 70), (160, 230)}
    covered = {i for r in rows if r["doc_id"] == 301 for i in range(r["start"], r["end"])}
    assert covered >= {*range(93), *range(293, 410)}


def test_passages_of_many_documents_whose_parts_stand_lower(spark: SparkSession) -> None:
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], set()
    for base in range(0, 100, 20):
        passage = fresh(50 + base)
        half = len(passage) // 2
        docs += [(base, [*fresh(40), *passage[:half][:45], *fresh(40)]), (base + 1, [*fresh(9), *passage[half:][-45:], *fresh(60)])]
        docs += [(k, [*fresh(rng.randrange(60)), *passage, *fresh(rng.randrange(60))]) for k in range(base + 2, base + 12)]
        want |= set(range(base + 2, base + 12))
    rows = substring_chains.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == want
    assert all(r["identity"] > 0.9 for r in rows)


def test_edited_passages_are_found(spark: SparkSession) -> None:
    """Recall of passages of 60 and 100 words of which 5, 10 and 15 % are replaced."""
    rng = random.Random(14)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, kinds = [], {}
    for size, share in itertools.product((60, 100), (0.05, 0.10, 0.15)):
        for _ in range(60):
            k = 2 * len(kinds)
            kinds[k] = (size, share)
            passage = fresh(size)
            changed = list(passage)
            for at in rng.sample(range(size), round(share * size)):
                changed[at] = "other"
            docs += [(k, [*fresh(50), *passage, *fresh(50)]), (k + 1, [*fresh(30), *changed, *fresh(70)])]
    rows = {r["doc_id"] for r in substring_chains.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")).collect()}
    recall = {x: np.mean([k in rows for k in kinds if kinds[k] == x]) for x in kinds.values()}
    # fixed values: measured 0.93, 0.75, 0.35 of 60 words and 1.00, 0.92, 0.73 of 100
    assert recall[60, 0.05] >= 0.9 and recall[60, 0.10] >= 0.7 and recall[100, 0.05] >= 0.98 and recall[100, 0.10] >= 0.88


def test_edited_passages_of_many_documents_need_no_common_head(spark: SparkSession) -> None:
    """each piece of the passage has a head of its own that has no more of it; two edited copies stand beside none of them."""
    rng = random.Random(15)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], set()
    for base in range(0, 100, 20):
        passage = fresh(70)
        edited = [w if i % 20 != 10 else "other" for i, w in enumerate(passage)]
        docs += [(base + k, [*fresh(30), *passage[at : at + 20], *fresh(40)]) for k, at in enumerate(x for x in range(0, 60, 10) for _ in range(3))]
        docs += [(base + 18, [*fresh(25), *passage, *fresh(25)]), (base + 19, [*fresh(35), *edited, *fresh(35)])]
        want |= {(base + 19, base + 18), (base + 18, base + 19)}
    line = fresh(24)
    docs += [(1000 + k, [*fresh(50), *line, *fresh(50)]) for k in range(40)]
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    assert {(r["doc_id"], r["other_id"]) for r in substring_chains.passages(frame).collect()} == want


def test_pairs_of_repeated_places_stay_few() -> None:
    assert len(substring_chains.meetings(list(range(0, 9000, 9)), list(range(5, 5000, 9)))) <= 2000
    assert set(substring_chains.meetings([1, 5, 90], [2, 30])) == {(d, h) for d in (1, 5, 90) for h in (2, 30)}


# near duplicates


def test_large_groups_lose_no_link(spark: SparkSession) -> None:
    """Chains of drifting copies around a common text: many members under the same lists."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
            words[at] = f"c{rng.randrange(6)}"
        docs.append((k, " ".join(words)))
    sets = {k: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for k, t in docs}
    part = {k: k for k, _ in docs}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                part[a] = part[b] = min(part[a], part[b])
                changed = True
    got = minhash_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == part
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)


# secrets


def test_places_of_secrets(spark: SparkSession) -> None:
    hexed = "0123456789abcdef" * 2
    texts = ["é\U0001f600 Password = 'hunter2x' x", f"{hexed} AKIA{'Z' * 16}", "token: abc", f"login=alice1 see https://api.example.org/v1 {'aB3' * 12}", f"https://api.example.org/v1 {'aB3' * 12}", "login=alice1", "x" * 300]
    rows = {r["doc_id"]: r for r in secret_links.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[k]["spans"].split(",")[0] for k in range(3)] == ["assign:3:23", "hex:0:32", ""]
    assert rows[1]["n_access"] == 1 and rows[1]["n_hex"] == 1
    assert [x.split(":")[0] for x in rows[3]["spans"].split(",")] == ["ident", "endpoint", "opaque"]
    assert rows[4]["spans"] == rows[5]["spans"] == rows[6]["spans"] == ""
    assert rows[6]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_parts_longer_than_the_scope(spark: SparkSession) -> None:
    texts = [f"{'0123456789abcdef' * 40} login=alice1", f"https://api.example.org/{'v' * 600} client_id=alice99 {'aB3' * 12}", f"login=alice1 {'x ' * 150} {'0123456789abcdef' * 40}"]
    rows = {r["doc_id"]: r["spans"] for r in secret_links.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0] == "hex:0:640,ident:641:653"
    assert [x.split(":")[0] for x in rows[1].split(",")] == ["endpoint", "ident", "opaque"]
    assert rows[2].startswith("hex:") and "ident" not in rows[2]


# pieces


def test_pieces_round_trip(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    first = queries.op10_piece_sampling(spark, FOLDER)
    assert first.where("not lossless").count() == 0
    assert piece_sampling.decoded(first).exceptAll(docs).count() == 0
    again = piece_sampling.encoded(docs.repartition(7, F.xxhash64("text")))
    assert again.select("doc_id", "pieces").exceptAll(first.select("doc_id", "pieces")).count() == 0


def test_samples_follow_the_lattice() -> None:
    """Shares of the sampled segmentations of one unit against all paths' weights."""
    vocab = piece_sampling.pieces()
    ids = {t: i for i, t in enumerate(vocab.text) if t}
    unit = "▁these"
    paths = []

    def walk(at: int, path: tuple[int, ...]) -> None:
        if at == len(unit):
            paths.append(path)
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in ids:
                walk(end, (*path, ids[unit[at:end]]))

    walk(0, ())
    weight = np.array([np.exp(vocab.log_weight[list(p)].sum()) for p in paths])
    n = 20_000
    points, offsets = code_points(*utf8(pa.array(["these"] * n)))
    seeds = np.array([piece_sampling._seed(k) for k in range(n)], np.uint64)
    out, bounds = piece_sampling.encode(vocab, points, offsets, seeds)
    seen = Counter(tuple(out[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert set(seen) <= set(paths)
    for p, w in zip(paths, weight / weight.sum(), strict=True):
        assert abs(seen[p] / n - w) < 0.015
