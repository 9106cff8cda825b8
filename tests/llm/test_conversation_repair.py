import hashlib
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from tests_rows import rows
from wayspark.llm import conversation_repair as M

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(turns):
    """Least cost and audit from the last turn back to the first, at most three insertions at a place."""
    add = lambda c, e, r: (c + r[0], e + r[1])

    @cache
    def rest(i, state, more=3):
        found = [(0, "")] if i == len(turns) and state in (M.EMPTY, M.DONE) else [(1 << 40, "")]
        if i < len(turns):
            found.append(add(2, "D", rest(i + 1, state)))
        for left, begin, t in M.PRODUCTIONS:
            if begin != state:
                continue
            if t != "s" and more:
                found.append(add(5, "I", rest(i, left, more - 1)))
            if i < len(turns) and turns[i][1] not in ("b", "d") and (t == turns[i][0] or t != "s"):
                same = t == turns[i][0]
                found.append(add((not same) + 5 * (turns[i][1] == "t"), "K" if same else "R", rest(i + 1, left)))
        return min(found)

    return rest(0, M.EMPTY)


def test_cheapest_edits():
    rng = random.Random(3)
    for _ in range(2000):
        turns = tuple((rng.choice("suax "), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(rng.randrange(9)))
        assert M.cheapest(turns) == plain(turns), turns


def test_tables_of_chunks_join_up(spark):
    rng = random.Random(5)
    data = []
    for conv in range(6):
        for i in range(rng.randrange(30, 90)):
            data.append((conv, rng.choice([None, i, i, i + 1]), rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(["a.", "b", " ", None, f"text {i}."])))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    whole = M.repair(df).toPandas()
    split = M.repair(df, long_turns=1).toPandas()
    assert rows(whole) == rows(split)
    assert rows(M.digests(M.repair(df)).toPandas()) == rows(M.digests(M.repair(df, long_bytes=0)).toPandas())


@pytest.mark.parametrize("long_turns", [1024, 1])
def test_odd_rows(spark, long_turns):
    data = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 5, "user", "cut off"),
        (2, 0, "system", "Rule."), (None, None, None, None), (None, None, "user", "x" * 100_000 + "."), (3, 0, "user", "a"), (4, None, "user", "Why?"),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"pos": F.lit(9), "audit": F.lit("z"), "a.b": F.lit(1)})
    df = df.withColumn("lost", F.coalesce(F.col("conv_id") == 3, F.lit(False)))
    got = {r.conv_id: r for r in M.digests(M.repair(df, long_turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].audit, got[1].cost, got[1].gaps, got[1].duplicate, got[1].truncated, got[1].illegal) == ("KKDD", 4, 3, 1, 1, 1)
    assert got[1].repaired_sha256 == sha("user:Hi.\nassistant:Yes!")
    assert (got[2].audit, got[2].repaired_sha256) == ("D", sha(""))
    assert (got[3].audit, got[3].cost, got[3].gaps, got[3].repaired_sha256) == ("", 0, 0, sha(""))
    assert (got[4].audit, got[4].gaps) == ("D", 0)
    assert (got[None].audit, got[None].blank, got[None].gaps, got[None].illegal) == ("DD", 1, 0, 1)
    turns = M.repair(df, long_turns).where("pos is not null").select("conv_id", "pos", "edit", "role", "text").collect()
    assert sorted(turns) == [(1, 1, "K", "user", "Hi."), (1, 2, "K", "assistant", "Yes!")]


def test_empty_table(spark):
    assert M.digests(M.repair(spark.createDataFrame([], SCHEMA))).count() == 0
    assert M.digests(M.repair(M.damaged(spark.createDataFrame([], SCHEMA)))).count() == 0
