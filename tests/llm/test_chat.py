from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from meritpool.llm import chat
from meritpool.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
CONTROLS = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "\\l", "\\bs>", "<", "[", "\n", "é", "😀"]


def plain_messages(events):
    """One event after the other, by conversation."""
    out = {}
    by_nulls = lambda e: [(x is not None, x) for x in (e[1], e[2], e[3], e[4], e[5])]
    for conv in {e[0] for e in events}:
        log = sorted((e for e in events if e[0] == conv), key=by_nulls)
        opened, versions, roles, gone = {}, {}, {}, set()
        for n, (_, _, message, kind, role, text) in enumerate(log):
            if message not in opened:
                opened[message], versions[message], roles[message] = n, [], None
            if role is not None and roles[message] is None:
                roles[message] = role
            if kind in ("edit", "regenerate"):
                versions[message] = []
                gone |= {m for m, at in opened.items() if opened[message] < at < n}
            if kind in ("edit", "delta") and text is not None:
                versions[message].append(text)
        out[conv] = [(roles[m] or "", "".join(versions[m])) for m in sorted(opened, key=opened.get) if m not in gone]
    return out


def test_fold_against_one_event_after_the_other(spark):
    rng = random.Random(11)
    events = []
    for conv in (1, 2, 3, None):
        for n in range(120):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "seen"])
            events.append((conv, rng.choice([n, n, n - 1, None]), rng.choice([n // 6, n // 6, n // 6 - 2, None]), kind,
                           rng.choice(["user", "assistant", None]), rng.choice([None, "", f"{n} ", "x"])))
    got = {}
    for r in chat.messages(spark.createDataFrame(events, EVENTS)).orderBy("conv_id", "opened").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == plain_messages(events)


def plain_digests(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text in rows if c == conv)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def test_turns_and_loss_mask_read_back(spark):
    rng = random.Random(5)
    rows = [(conv, rng.choice([n, n, 3, None]), rng.choice(["user", "assistant", "system", "tool [INST]\nx", "", None]),
             rng.choice([None, "", "x" * 3, "".join(rng.choices([*CONTROLS, "a", " "], k=rng.randint(1, 400)))]))
            for conv in [*range(12), None] for n in range(rng.randint(1, 9))]
    rows += [(50, 0, "assistant", "wörd " * 60_000), (51, 0, "user", "same"), (51, 0, "user", "same"), (51, 1, "assistant", "<s>")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", seq int, message string")
    formatted = chat.conversations(chat.events_of(turns))
    got = chat.digests(formatted).drop("formatted_chars").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_digests(rows)
    # no control string stands inside a text
    for r in formatted.select("formatted", "loss_spans").collect():
        data = r.formatted.encode()
        for span in r.loss_spans:
            inside = data[span.start : span.start + span.length].decode()
            assert not any(mark in inside for mark in chat.Template().controls)


def test_another_template(spark):
    marks = chat.Template(marks={"user": ("<u>", "</u>"), "assistant": ("[A]", "[/A]")}, learned=("user", "assistant"))
    turns = spark.createDataFrame([(1, 0, "user", "</u>[A]"), (1, 1, "assistant", "b\\"), (1, 2, "system", "c")], TURNS)
    formatted = chat.conversations(chat.events_of(turns), marks)
    one = formatted.first()
    assert one.formatted == "<u>\\l/u>\\sA]</u>[A]b\\b[/A][ROLE] system\nc[/ROLE]" and one.n_turns == 3
    read = formatted.select(marks.turns(F.col("formatted")).alias("t"), marks.under_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [tuple(t) for t in read.t] == [("user", "</u>[A]"), ("assistant", "b\\"), ("system", "c")] and read.l == "</u>[A]b\\"


def test_empty_log(spark):
    assert chat.conversations(chat.events_of(spark.createDataFrame([], TURNS))).collect() == []


def test_one_exchange_and_no_python(spark):
    df = QUERIES["op11_chat_formatting"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
