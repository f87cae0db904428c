import hashlib
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavepanel.llm import conversations as C
from wavepanel.llm.queries import op13_conversation_repair
from tests.conftest import SF_SMALL

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       # names that the operator uses itself
                       T.StructField("id", T.StringType()), T.StructField("times", T.StringType()),
                       T.StructField("part", T.StringType())])


def least(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, kind), plainly."""
    n = len(rows)
    sys.setrecursionlimit(50_000)

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == n and state in "0a":
            found.append((0, "", ()))
        put = "assistant" if state == "u" else "user"
        if inserts < 3:
            c, audit, lines = best(i, put[0], inserts + 1)
            found.append((c + 5, "I" + audit, (f"{put}:", *lines)))
        if i < n:
            role, text, kind = rows[i]
            c, audit, lines = best(i + 1, state, 0)
            found.append((c + 2, "D" + audit, lines))
            if kind in ("ok", "truncated"):
                more = 5 * (kind == "truncated")
                x = role[:1]
                if x and (x == put[0] or (x == "s" and state == "0")):
                    c, audit, lines = best(i + 1, x, 0)
                    found.append((c + more, "K" + audit, (f"{role}:{text}", *lines)))
                c, audit, lines = best(i + 1, put[0], 0)
                found.append((c + more + 1, "R" + audit, (f"{put}:{text}", *lines)))
        return min(found) if found else (10 ** 9, "~", ())

    return best(0, "0", 0)


def brute(records, damaged=True):
    convs = defaultdict(list)
    for conv, turn, role, text in records:
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv]
        times = 1
        if damaged:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            if fault == 0:
                continue
            if fault == 1:
                text = ""
            if fault == 2:
                text = text.translate(str.maketrans("", "", ".!?"))
            if fault == 3:
                times = 2
            if fault == 4:
                role = "user"
        convs[conv] += [(turn, role, text)] * times
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in rows:
            body = text.rstrip(WHITE)
            kind = "blank" if not body else "duplicate" if (role, text) in seen else "ok" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            kinds.append((role, text, kind))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
        cost, audit, lines = least(tuple(kinds))
        n = lambda k: sum(x == k for _, _, x in kinds)
        out[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    rows = df.collect()
    found = {r[0]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def frame(spark, records, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in records], SCHEMA).repartition(parts)


def mixed_records():
    roles = ["user", "assistant", "system", None, "", "tool", "Unknown", "under"]
    texts = ["Fine.", "Cut off", None, "", " \t ", "Why?  ", "Good!\n", "Fine.", "a　", "end. "]
    return [(conv if conv else None, turn if (conv + turn) % 7 else None, roles[(conv * turn + turn * 3 + conv) % 8],
             texts[(conv + turn * 5 + conv * turn) % 10]) for conv in range(60) for turn in range(conv % 11)]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert result(op13_conversation_repair(spark, SF_SMALL)) == brute([tuple(r) for r in rows])


def test_awkward_rows(spark):
    records = mixed_records() + [(3, 1, "user", "Fine.")] * 5 + [(7, 2, "user", "w" * 50_000 + ".")] * 2
    assert result(C.repair(C.damage(frame(spark, records)), times="times").digests()) == brute(records)
    assert result(C.repair(frame(spark, records)).digests()) == brute(records, damaged=False)


@pytest.mark.parametrize("segment_rows", [1, 3, 4096])
def test_one_conversation_over_many_tasks(spark, segment_rows):
    """Segments of any size, also of one row, give the same results."""
    roles = ["user", "assistant", "user", "system", "assistant", "assistant"]
    hot = [(99, i // 2, roles[i * i % 6], f"text {i % 40 * (i % 3)}" + "." * (i % 4 > 0)) for i in range(300)]
    hot += [(None, None, "user", "Same.")] * 200 + [(98, i, "user", "Same.") for i in range(150)]
    records = mixed_records() + hot
    found = result(C.repair(C.damage(frame(spark, records, 5)), times="times", segment_rows=segment_rows).digests())
    want = brute(records)
    assert found == want
    assert len(found[99][6]) > 250


def test_dropped_and_empty(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = result(C.repair(C.damage(frame(spark, [(gone, 0, "user", "Hello.")])), times="times").digests())
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    none = C.repair(C.damage(frame(spark, [])), times="times").digests()
    assert none.collect() == [] and none.columns == ["conv_id", *COLUMNS]


def test_ties_take_the_first_audit():
    """Two ways of cost 5 and more: the audit that sorts first wins."""
    rows = [(r, "x.", "ok") for r in ("user", "user", "assistant", "assistant", "user", "system")]
    kinds, initials = bytes([0] * 6), bytes(C.INITIALS[r[0]] for r, _, _ in rows)
    paths = C.Paths([kinds], [initials], C.end_goal()[None], C.np.ones(1, bool))
    cost, audit, _ = least(tuple(rows))
    assert paths.audits(C.np.zeros(1, int))[0][0] == audit
    assert paths.cost[0] == cost


def test_every_repair_is_legal(spark):
    out = C.repair(frame(spark, mixed_records()))
    lines = out.whole.select(F.explode(F.split("transcript", "\n(?=user:|assistant:|system:|under:|Unknown:)")).alias("l"), "id")
    assert lines.count() > 0
    said = out.whole.select("id", F.regexp_replace("audit", "[^D]", "").alias("d"), "blank", "duplicate", "cost").collect()
    assert all(len(r.d) >= r.blank + r.duplicate and r.cost >= 2 * len(r.d) for r in said)
