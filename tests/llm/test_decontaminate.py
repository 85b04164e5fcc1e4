import random
import re

from conftest import EDGES

from conceptframe.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOW))


def brute(rows, items, size=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).update([] if i is None else [str(i)])
    out = []
    for doc, t in rows:
        w = words(t)
        hit, own = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k:k + n]))) is not None:
                    own |= found
                    hit |= set(range(k, k + n))
        out.append((str(doc), len(w), len(hit), ",".join(sorted(own)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def found(docs, items, **options):
    out = decontaminate.contamination(docs, items, **options).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in out)


def cases(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["a", "B", "cé", "d1", "..", "E-f"]) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for i in range(14)] + [(90, None), (None, "a b"), (3, "d1 d1 d1 a")]
    rows = [(i, some(rng.choice([0, 1, 3, 20, 80]))) for i in range(40)] + [(100 + i, f"{some(9)} {t} {some(4)}") for i, t in items if i is not None]
    return rows + EDGES, items


def test_hits_are_those_of_brute_force(spark, table):
    for seed in (1, 2):
        rows, items = cases(seed)
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        assert found(table(rows), bench) == brute(rows, items)
        assert found(table(rows), bench, most=40) == brute(rows, items)  # several blocks of items


def test_longest_match(spark, table):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "x " + " ".join(passage.split()[3:33]) + " y"), (2, "nothing at all")]
    out = {r.doc_id: r for r in decontaminate.contamination(table(rows), spark.createDataFrame([(7, passage)], "item_id bigint, text string")).collect()}
    assert out[1].longest_match == 30 and out[2].longest_match == 0
    assert [tuple(x) for x in out[1].locations] == [(1, 30)]


def test_clean_documents_stay_with_all_columns(spark, table):
    rows, items = cases(3)
    df = table(rows)
    kept = decontaminate.decontaminated(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(d for d, *_, bad in brute(rows, items) if not bad)


def test_no_rows(spark, table):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(table([]), none).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(table(EDGES), none).collect()} == {0}


def test_a_repeated_item_row_counts_once_in_one_block_and_in_several(spark, table):
    bench = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (7, "two three"), (8, "three")], "item_id bigint, text string")
    for options in ({}, {"most": 5}):
        one = decontaminate.contamination(table([(1, "x one two three y")]), bench, **options).first()
        assert (one.n_items, one["items"], one.n_hit) == (2, ["7", "8"], 3)


def test_items_without_id_hit_and_name_nothing(spark, table):
    items = spark.createDataFrame([(None, "one two three"), (5, "nine ten")], "item_id bigint, text string")
    rows = [(1, "x one two three y"), (2, "nine ten one two three"), (3, "one two")]
    for most in (1 << 20, 10):
        assert found(table(rows), items, most=most) == [("1", 5, 3, "", True), ("2", 5, 5, "5", True), ("3", 2, 0, "", False)]
