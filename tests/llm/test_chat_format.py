import random
import re

import pytest
from pyspark.sql import functions as F

from evidencelake.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, window long, block string, tokens string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "t") for r in rows], SCHEMA)


def conversations():
    random.seed(6)
    tricky = ["<|end|>", "\\", "<\\|turn|>", "<|text|>x", "a<", "|end|>", "\\### Assistant: </turn> ok", "", None, "é 漢字", "line\nline"]
    rows = []
    for c in range(40):
        n = random.choice([1, 2, 5, 30, 90])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, random.choice(tricky) if random.random() < 0.4 else "word " * random.choice([1, 20, 200, 900])))
    rows += [
        (200, None, None, None),
        (200, 1, "assistant", "x"),
        (200, 1, "assistant", "x"),
        (None, 0, "user", "no conversation"),
        (None, 1, "assistant", "yes"),
        (201, 0, "us<|text|>er\n", "odd role"),
        (202, -5, "user", "a"),
        (202, 10**7, "assistant", "b"),
    ]
    return rows


def plain(rows):
    found = {}
    for c, t, r, x in rows:
        found.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {
        c: (
            "".join(f"{r}\n{x}\n" for _, _, r, x in sorted(v)),
            "".join(x for _, _, r, x in sorted(v) if r == "assistant"),
            len(v),
        ) for c, v in found.items()
    }


@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"budget": 256, "history_tokens": 64},
        {"history_turns": 0},
        {"history_turns": 4, "budget": 600},
        {"block_turns": None},
        {"block_turns": 8, "budget": 300},
    ],
)
def test_reads_back_what_it_formats(spark, settings):
    rows = conversations()
    windows = C.format_windows(frame(spark, rows), **settings)
    got = {r["conv"]: (r["turns"], r["loss_text"], r["n_turns"]) for r in C.read_turns(windows).collect()}
    assert got == plain(rows)


def test_windows_keep_the_budget_the_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be kind " * 10)] + [(1, t, ["assistant", "user"][t % 2], f"turn {t} " + "word " * 60) for t in range(1, 60)]
    out = sorted(C.format_windows(frame(spark, rows), budget=600, history_tokens=150).collect(), key=lambda r: r["window"])
    assert len(out) > 3
    for k, r in enumerate(out):
        turns = r["formatted"].split(C.END)[:-1]
        assert r["tokens"] <= 600 and turns[0].startswith(C.TURN + "system")
        if k:
            earlier = out[k - 1]["formatted"].split(C.END)[:-1]
            assert 1 < r["n_repeated"] <= 3 and turns[1 : r["n_repeated"]] == earlier[-(r["n_repeated"] - 1) :]
        fresh = [t for t in turns[r["n_repeated"] :] if t.startswith(C.TURN + "assistant")]
        assert [r["formatted"][a : a + n] for a, n in r["targets"]] == [t.split(C.TEXT)[1] for t in fresh]


@pytest.mark.parametrize("block_turns", [None, 8, 256])
def test_no_window_exceeds_the_budget_beside_a_long_system_turn(spark, block_turns):
    random.seed(3)
    rows = [(c, 0, "system", "k" * size) for c, size in enumerate((7200, 6000, 3000, 100, 8100, 9000))]
    rows += [(c, t, ["assistant", "user"][t % 2], "w" * random.choice([1, 80, 300, 320, 900])) for c in range(6) for t in range(1, 60)]
    out = C.format_windows(frame(spark, rows), block_turns=block_turns).collect()
    tokens = lambda x: -(-len((x + C.END).encode()) // 4)
    seen = {c: [] for c in range(6)}
    for r in sorted(out, key=lambda r: (r["conv"], r["window"])):
        turns = r["formatted"].split(C.END)[:-1]
        assert r["tokens"] == sum(map(tokens, turns)) and turns[0].startswith(C.TURN + "system") and r["window"] == len(seen[r["conv"]])
        fresh = turns[r["n_repeated"] :]
        # what came before is repeated, without a gap, in its order
        history = turns[1 : r["n_repeated"]]
        assert history == (seen[r["conv"]][-len(history) :] if history else []) and len(history) <= C.HISTORY_TURNS
        seen[r["conv"]] += fresh
        new = turns[max(r["n_repeated"], 1) :]
        assert r["tokens"] <= C.BUDGET or (len(new) == 1 and not history and tokens(turns[0]) + tokens(new[0]) > C.BUDGET)
    assert all(len(x) == 60 for x in seen.values())
    assert {r["conv"] for r in out if r["tokens"] > C.BUDGET} <= {4, 5}


def test_texts_are_shuffled_once(spark):
    read = C.read_turns(C.format_windows(frame(spark, conversations()), block_turns=None), whole_parts=True)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_an_oversized_turn_stands_alone(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "word " * 9000), (1, 2, "user", "b")]
    out = C.format_windows(frame(spark, rows)).collect()
    assert len(out) == 3 and sum(r["tokens"] > C.BUDGET for r in out) == 1


def test_native_and_empty(spark):
    df = frame(spark, conversations())
    plan = C.read_turns(C.format_windows(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert C.read_turns(C.format_windows(df.where(F.lit(False)))).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["\\", "<|", "<\\|", "\\<|\\", "", "a\nb", "<<||", "\\\\<\\\\|"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        C.unescape(C.escape(F.col("t"))).alias("u"),
        C.escape(F.col("t")).alias("e"),
    ).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in rows)
