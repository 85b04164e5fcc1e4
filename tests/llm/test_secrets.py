import random

from conftest import EDGES

from conceptframe.llm import secrets


def corpus(n=400):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "re", "on", "ti", "es"]) for _ in range(rng.randint(1, 4)))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    rows, truth = [], {}
    for i in range(n):
        words = [word() for _ in range(30)]
        kind = i % 4
        if kind == 0:
            value = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(14)) + "A1"
            words[9] = value
        elif kind == 1:
            value = hexa(18) + "a1"
            words[9] = f"password={value}"
        elif kind == 2:
            value = "".join(rng.choice("0123456789") for _ in range(16))
            words[9] = value
        else:
            value = f"path/anthereonties-{rng.randint(100, 999)}"
            words[9] = f"{value}.txt"
        rows.append((i, " ".join(words)))
        truth[i] = (value, kind < 2)
    return rows, truth


def test_candidates(table):
    rows = [(1, 'x token = "1beb58b8af68854f0e01" y'), (2, "see https://host.example/a1b2c3d4e5f6g7h8i9 now"), (3, "onlylettersinthislongword"),
            (4, "password=7602ad27cf5550de1c"), (5, None), (6, "short1")]
    out = {r.doc_id: r for r in secrets.candidates(table(rows)).collect()}
    assert set(out) == {1, 2, 4}
    assert (out[1].value, out[1].path, out[1].before, out[1].after, out[1].word) == ("1beb58b8af68854f0e01", '"', "=", "y", 3)
    assert (out[4].value, out[4].path) == ("7602ad27cf5550de1c", "password=")
    assert out[2].before == "see" and out[2].value.endswith("a1b2c3d4e5f6g7h8i9")


def test_features(table):
    rows = [(1, "the abcDEF123456ghi. and")]
    one = secrets.described(secrets.candidates(table(rows)), ["abcd", "ghij"]).first()
    assert one.length == 15 and abs(one.transitions - 3 / 15) < 1e-9 and abs(one.digits - 6 / 15) < 1e-9 and abs(one.capitals - 3 / 15) < 1e-9
    assert abs(one.covered - 4 / 15) < 1e-9 and one.plain_before == 1 and one.plain_after == 1 and one.assigned == 0


def test_held_out_findings_of_given_labels(spark, table):
    rows, truth = corpus()
    known = spark.createDataFrame([(i, v, float(s)) for i, (v, s) in truth.items() if i % 5], "doc_id bigint, value string, label double")
    out = secrets.secret_scan(table(rows), known).collect()
    judged = {r.doc_id: r.secret for r in out}
    held = [i for i in truth if i % 5 == 0]
    assert sum(judged.get(i) == int(truth[i][1]) for i in held) >= 0.95 * len(held)


def test_edges(spark, table):
    assert secrets.secret_scan(table([])).count() == 0
    out = secrets.secret_scan(table(EDGES))
    assert out.count() == 0
    some = secrets.secret_scan(table([(None, "k 1beb58b8af68854f0e01aa1beb58b8af68854f0e"), (1, "k 1beb58b8af68854f0e01aa1beb58b8af68854f0e"), (1, "k 1beb58b8af68854f0e01aa1beb58b8af68854f0e")]))
    assert [r.secret for r in some.collect()] == [1, 1, 1]


def test_nothing_leaves_the_jvm(table):
    plan = secrets.secret_scan(table(corpus(60)[0]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_each_label_has_its_share_of_a_small_sample(table):
    rows = [(i, f"and {10**15 + i} then") for i in range(300)] + [(1000 + i, f"and AKIA{chr(65 + i) * 8}QZ7X{i:04d} then") for i in range(4)]
    out = {r.doc_id: r for r in secrets.secret_scan(table(rows), train=20).collect()}
    assert all(out[1000 + i].secret == 1 for i in range(4))
    assert sum(r.secret for r in out.values()) == 4


def test_short_and_broken_values_near_a_keyword_or_assignment(table):
    rows = [(1, "password=hunter2"), (2, "the password is swordfish then"), (3, 'key: "a.b!c@d" x'), (4, '{"token":"abc.1!x","b":"c"}'),
            (5, "pass=a"), (6, "https://user:pw@host/?q=1"), (7, "password=correcthorsebattery"), (8, "key1=7602ad27cf5550de1c"), (9, "nothing to see here")]
    out = {}
    for r in secrets.candidates(table(rows)).collect():
        out.setdefault(r.doc_id, {})[r.value] = r.path
    assert out[1] == {"hunter2": "password="}
    assert out[2] == {"is": "", "swordfish": ""}
    assert out[3]["a.b!c@d"] == '"'
    assert out[4] == {"abc.1!x": '{"token":"', "c": '{"token":"abc.1!x","b":"'}
    assert out[5] == {"a": "pass="}
    assert out[6] == {"pw@host/": "https://user:", "1": "https://user:pw@host/?q="}
    assert out[7] == {"correcthorsebattery": "password="}
    assert "7602ad27cf5550de1c" in out[8]
    assert 9 not in out


def test_hexadecimal_values_in_capitals(table):
    one = secrets.sure_labels(secrets.described(secrets.candidates(table([(1, "x " + "1BEB58B8" * 4)])), [])).first()
    assert one.hexadecimal == 1 and one.label == 1


def test_what_defines_the_labels_is_no_feature(table):
    out = secrets.secret_scan(table(corpus(60)[0]))
    assert out.filter("label is not null").count() > 0 and secrets.FORM < set(secrets.FEATURES)
