"""Stage runs that are killed, paused and taken up again; what they look at."""

import os

import pytest
from pyspark.sql import functions as F

from waymark.operators import stages
from waymark.operators.models import Unavailable


def requests(spark, n, done=()):
    rows = spark.createDataFrame([(f"k{i:03d}", f"r{i}", "held" if i % 10 == 9 else None, i) for i in range(n)], "key string, request string, why string, t long")
    rows = rows.withColumn("key", F.when(F.col("why").isNull(), F.col("key"))).withColumn("why", F.when(F.col("why").isNotNull(), "withheld"))
    return stages._selection(rows, spark.createDataFrame([(k,) for k in done], "key string"), F.asc("t"))


def model_that(folder, breaks_at=None, pauses_at=None):
    """Answers and notes each request in a file of its own; breaks or pauses at one."""

    def model(texts):
        out = []
        for t in texts:
            if t == breaks_at:
                raise RuntimeError("broken")
            if t == pauses_at:
                raise Unavailable
            with open(os.path.join(folder, t), "a") as f:
                f.write("x")
            out.append((None, "model refused") if int(t[1:]) % 4 == 0 else (f"said {t}", None))
        return out

    return model


def asked(folder):
    return {f: os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)}


def test_a_killed_run_keeps_its_waves(spark, tmp_path):
    store, notes = str(tmp_path / "store"), tmp_path / "notes"
    notes.mkdir()
    with pytest.raises(Exception, match="broken"):
        stages.run(requests(spark, 60), model_that(str(notes), breaks_at="r33"), store, "v1", wave=10, batch=3)
    kept = {r.key for r in stages.results(spark, store).collect()}
    pending = [i for i in range(60) if i % 10 != 9]
    assert kept == {f"k{i:03d}" for i in pending[:30]}  # three waves of ten
    before = asked(str(notes))
    got = stages.run(requests(spark, 60, done=kept), model_that(str(notes)), store, "v1", wave=10, batch=3)
    assert got == stages.Report(done=24 - sum(i % 4 == 0 for i in pending[30:]), already=30, refused=sum(i % 4 == 0 for i in pending[30:]), unreferenced=0, withheld=6, paused=False)
    rows = stages.results(spark, store).collect()
    assert {r.key for r in rows} == {f"k{i:03d}" for i in pending} and len(rows) == 54
    assert all(n == 1 for f, n in asked(str(notes)).items() if int(f[1:]) in pending[:30])  # nothing kept is asked again
    assert before.keys() <= asked(str(notes)).keys()


def test_a_model_out_of_reach_pauses_and_the_next_run_goes_on(spark, tmp_path):
    store, notes = str(tmp_path / "store"), tmp_path / "notes"
    notes.mkdir()
    got = stages.run(requests(spark, 40), model_that(str(notes), pauses_at="r15"), store, "v1", wave=8, batch=1)
    assert got.paused and got.withheld == 4
    have = {r.key for r in stages.results(spark, store).collect()}
    assert {f"k{i:03d}" for i in range(8)} <= have and "k015" not in have
    got = stages.run(requests(spark, 40, done=have), model_that(str(notes)), store, "v1", wave=8, batch=1)
    assert not got.paused and got.already == len(have)
    assert stages.results(spark, store).count() == 36


def test_limits_order_repeated_keys_and_empty_selections(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r1", 2), ("a", "r2", 1), ("b", "r3", 3), ("c", "r5", 4)], "key string, request string, t long").withColumn("why", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "key string")
    looked = stages._selection(rows, none, F.asc("t"))
    assert [(r.key, r.request, r.status) for r in looked.orderBy("nth").collect()] == [("a", "r2", "pending"), ("a", "r1", "already"), ("b", "r3", "pending"), ("c", "r5", "pending")]
    assert [r.key for r in stages.within(looked, 2).orderBy("nth").collect()] == ["a", "a", "b"]
    assert stages.within(looked, 0).count() == 0 and stages.within(looked, 9).count() == 4
    notes = tmp_path / "notes"
    notes.mkdir()
    got = stages.run(looked, model_that(str(notes)), str(tmp_path / "s"), "v", limit=2)
    assert got == stages.Report(2, 1, 0, 0, 0, False) and set(asked(str(notes))) == {"r2", "r3"}
    assert stages.run(looked.limit(0), model_that(str(notes)), str(tmp_path / "t"), "v") == stages.Report(0, 0, 0, 0, 0, False)
    assert stages.results(spark, str(tmp_path / "t")).count() == 0


def test_subject_answers(spark):
    rows = [("a", '```json\n["Dog ", "dog", "", "Sea"]\n```', None), ("b", "no list " * 30, None), ("c", None, "model refused"), ("d", "[]", None), ("e", "[1, broken", None)]
    got = {r.key: (r.labels, r.refused) for r in stages.read_subjects(spark.createDataFrame([(*r, "v") for r in rows], stages.RESULT)).collect()}
    assert got == {"a": (["dog", "sea"], None), "b": ([], "unparseable answer: " + ("no list " * 30)[:80]), "c": ([], "model refused"), "d": ([], "unparseable answer: []"), "e": ([], "unparseable answer: [1, broken")}


def test_themes_of_many_labels_equal_the_plain_definition():
    import time

    import numpy as np

    from waymark.config import DEFAULT
    from waymark.operators.models import theme_groups

    def plain(vectors, stays, order):
        unit, groups = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), []
        for i in order:
            sims = [float(unit[i] @ (unit[g].mean(0) / np.linalg.norm(unit[g].mean(0)))) for g in groups]
            at = max(range(len(sims)), key=lambda k: (sims[k], -k), default=None)
            share = at is not None and stays[i] and len(stays[i] & set().union(*(stays[m] for m in groups[at]))) / len(stays[i]) >= DEFAULT.theme_shared
            if at is not None and (sims[at] >= DEFAULT.theme_strong or (sims[at] >= DEFAULT.theme_weak and share)):
                groups[at].append(i)
            else:
                groups.append([i])
        return [g for g in groups if len(g) >= DEFAULT.min_members]

    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 48))
    make = lambda n: (base[rng.integers(0, 300, n)] + rng.normal(size=(n, 48)) * rng.choice([0.4, 0.8, 1.2], (n, 1)), [set(rng.integers(0, 30, rng.integers(0, 4)).tolist()) for _ in range(n)])
    vectors, stays = make(500)
    assert theme_groups(vectors, stays, list(range(500))) == plain(vectors, stays, range(500))
    vectors, stays = make(20_000)
    began = time.time()
    groups = theme_groups(vectors, stays, list(range(20_000)))
    assert sum(map(len, groups)) > 5_000 and time.time() - began < 120


def test_narration(spark):
    from waymark.operators import telling

    owners = spark.createDataFrame([(1,), (2,), (3,)], "owner_id long")
    own = spark.createDataFrame([(1, 2, "Place b."), (1, 1, "Place a."), (1, 1, "Near a: x."), (2, 0, "12 outings.")], "owner_id long, nth int, fact string")
    shared = spark.createDataFrame([(1, "Subject s.")], "nth int, fact string")
    listed = telling.facts_in_order(owners, [own, shared.limit(0)])
    assert {r.owner_id: r.facts for r in listed.collect()} == {1: ["Near a: x.", "Place a.", "Place b."], 2: ["12 outings."], 3: []}
    assert [r.p for r in telling.facts_in_order(owners.filter("owner_id = 1"), [own, shared]).select(telling.prompt(F.col("facts")).alias("p")).collect()] == ["[F1] Near a: x.\n[F2] Place a.\n[F3] Place b.\n[F4] Subject s."]

    def model(instruction, prompts):
        assert instruction.endswith("in Japanese. Warm and concrete; no flattery.")
        return [("12 outings [F1]; 13 of them [F7].", None) if "outings" in p else (None, "model refused") for p in prompts]

    got = {r.owner_id: tuple(r)[1:] for r in telling.tell(listed.coalesce(1), model, telling.system(telling.PROFILE_SYSTEM, "ja")).collect()}
    assert got == {1: (None, "model refused", []), 2: ("12 outings [F1]; 13 of them [F7].", None, ["unknown citation", "unsupported number"]), 3: ("", None, [])}

    def away(instruction, prompts):
        raise Unavailable

    assert [r.owner_id for r in telling.tell(listed.coalesce(1), away, "x").collect()] == [3]
