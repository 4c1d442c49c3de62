"""Repairs against a search without a graph, whole and in parts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from zonewright.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?").fullmatch
BLANK = "\t\n\x0b\x0c\r "


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(key.encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def ways(rows):
    """Every repair with at most two inserts in a row: (cost, audit, repaired rows)."""
    inserts = [()] + [x for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for role, text, kind in rows:
        here = [(4, "D", ())]
        if kind != "gone":
            more = 3 * (kind == "truncated")
            here += [(more, "K", (role + ":" + text,))] + [(3 + more, "R", (r + ":" + text,)) for r in ("user", "assistant")]
        choices += [[(3 * len(x), "I" * len(x), tuple(r + ":" for r in x)) for x in inserts], here]
    choices.append([(3 * len(x), "I" * len(x), tuple(r + ":" for r in x)) for x in inserts])
    for pick in itertools.product(*choices):
        kept = [r for x in pick for r in x[2]]
        if SHAPE("".join(r[:1] for r in kept)):
            yield sum(x[0] for x in pick), "".join(x[1] for x in pick), kept


def least(rows):
    """The same by the cheapest (cost, audit, repaired) for each prefix shape, from the last row to the first: for longer conversations."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}
    nxt = {"": "user", "s": "user", "u": "assistant", "ua": "user"}
    after = {"": (0, "", []), "s": (6, "II", ["user:", "assistant:"]), "u": (3, "I", ["assistant:"]), "ua": (0, "", [])}

    def put(cost, letter, kept, rest):
        return (cost + rest[0], letter + rest[1], kept + rest[2])

    for role, text, kind in reversed(rows):
        own = {}
        for q in step:
            found = [put(4, "D", [], after[q])]
            if kind != "gone":
                more = 3 * (kind == "truncated")
                if role[:1] in step[q]:
                    found.append(put(more, "K", [f"{role}:{text}"], after[step[q][role[:1]]]))
                found.append(put(3 + more, "R", [f"{nxt[q]}:{text}"], after[step[q][nxt[q][0]]]))
            own[q] = min(found)
        after = {}
        for q in step:
            one = step[q][nxt[q][0]]
            two = step[one][nxt[one][0]]
            after[q] = min(own[q], put(3, "I", [nxt[q] + ":"], own[one]), put(6, "II", [nxt[q] + ":", nxt[one] + ":"], own[two]))
    return after[""]


def classes(rows):
    """Rows in order with what they are, and the counts of first faults."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out, counts = set(), [], defaultdict(int)
    for _, _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        out.append((role, text, "gone" if fault in ("blank", "duplicate") else fault))
    return out, counts


def plain(original):
    by = defaultdict(list)
    for r in damage(original):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in original}:
        rows = by[conv]
        got, counts = classes(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(got))
        cost, audit, kept = least(got)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made_up(seed, n):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        turn = draw.randrange(3)
        for _ in range(draw.randrange(1, 14)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = draw.choice(["Well.", "Well.", "So it goes", "", " \t", "Ja! ", "Ünicode?", None, f"t{draw.randrange(9)}.", "é"])
            rows.append((conv, draw.choice([turn, turn, turn, None]) if draw.random() < 0.2 else turn, role, text))
            turn += draw.choice([0, 1, 1, 1, 1, 2, 3])
    return rows + [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho."), (-5, None, "user", "x")]


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_graph_equals_every_repair():
    draw = random.Random(3)
    for k in range(60):
        rows = [(draw.choice(["system", "user", "assistant", "x"]), draw.choice("ab"), draw.choice(["", "", "truncated", "gone"])) for _ in range(1 + k % 2 + (k % 20 == 19))]
        want = min(ways(rows))
        assert least(rows) == want
        steps = [(r[:1], {"": 0, "truncated": 1, "gone": 2}[k]) for r, _, k in rows]
        d = repair.distances(steps, list(repair._END))
        audit, _ = repair.walk(steps, d, 0, True)
        assert (d[0][0], audit) == want[:2]
        assert repair.replay(audit, 0, [r for r, _, _ in rows], [t for _, t, _ in rows]) == want[2]


def test_equals_plain_version(spark):
    rows = made_up(1, 300)
    assert results(repair.repair(repair.damaged(table(spark, rows)))) == plain(rows)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_parts_change_nothing(spark, size):
    rows = made_up(2, 60) + [(1000, k, ("user", "assistant", "system")[k * k % 3], f"t{k % 37}" + "." * (k % 3)) for k in range(400)]
    assert results(repair.repair(repair.damaged(table(spark, rows)), part_rows=size)) == plain(rows)


def test_one_conversation_of_many_rows_is_dealt_out(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"Text {k}.") for k in range(3000)] + [(2, k, "user", "same.") for k in range(50)] + [(3, 1, "user", "again.")] * 2000
    assert results(repair.repair(repair.damaged(table(spark, rows)), part_rows=64)) == plain(rows)


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = results(repair.repair(repair.damaged(table(spark, [(gone, 0, "user", "x.")]))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_text_ids_long_texts_and_extra_columns(spark):
    rows = made_up(4, 30)
    df = table(spark, rows).withColumns({"first": F.lit(1), "n": F.lit("x"), "digest": F.lit(2), "pid": F.lit(3), "_fault": F.lit(4)})
    assert results(repair.repair(repair.damaged(df))) == plain(rows)
    named = repair.repair(repair.damaged(df.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))))
    assert dict(named.dtypes)["conv_id"] == "string" and {r.conv_id for r in named.collect()} == {None if r[0] is None else f"c{r[0]}" for r in rows}
    long = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "y" * 2_000_000 + "!"), (2, 0, "user", "z" * 3_000_000)]
    assert results(repair.repair(repair.damaged(table(spark, long)))) == plain(long)
