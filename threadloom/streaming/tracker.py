"""A case tracker over a stream: ledger, state and time-outs of every conversation, message by message.

Messages may come in any order within the watermark's delay. Each is kept until the watermark has
passed it, then processed in the order of time (and of id, where times are equal), so that a
replay in any micro-batches gives what the batch operators give at every point. A conversation's state has
a fixed size but for the messages that wait: flags and tails of the two running texts, counts, the
last message's open items. It is dropped when nothing has come for ``gap``.

Rows: kind ``state`` (at each customer message), ``item`` (of the ledger, once its result is
known), ``closed`` (with the number of messages). Messages later than the watermark are dropped by
Spark, which counts them; repeated ids within a conversation's open time count once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from threadloom.functions import running
from threadloom.functions.vocab import OWN_ATTEMPT, RESULT_PATTERNS, STATE_PATTERNS, STATES
from threadloom.operators import ledger, state

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "conversation_id string, kind string, pos long, item long, message_id string, action string, explicitness string, result string, state string, messages long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Patterns:
    """The rule tables, compiled, with the reach that a match in running text needs."""

    def __init__(self, states: dict[str, str], actions: dict[str, str], results: dict[str, str], own: str):
        test = lambda p: re.compile(p, re.IGNORECASE)
        self.now = {n: test(states[n]) for n in (*state.SAID_NOW, "failure")}
        self.sides = {**{n: ("support", *running.split(states[n])) for n in state.SAID_BY_SUPPORT}, **{n: ("customer", *running.split(states[n])) for n in state.SAID_BY_CUSTOMER}, **{f"diagnostic_{r}": (r, *running.split(states["diagnostic"])) for r in ("customer", "support")}}
        widths = [running.width(a) for _, bounded, _ in self.sides.values() for a in bounded] + [running.width(a) + running.width(b) + 1 for _, _, pairs in self.sides.values() for a, b in pairs]
        self.reach = max([*widths, running.width(states["diagnostic"])]) + 2
        ends = running.LINE_END
        self.found = {n: [test(f"{running.BEHIND}(?:{a})") for a in (*bounded, *(f"{a}[^{ends}]*{b}" for a, b in pairs))] for n, (_, bounded, pairs) in self.sides.items()}
        self.open = {n: [(running.width(b), test(f"{running.BEHIND}(?:{a})[^{ends}]*\\Z"), test(f"\\A[\\s\\S][^{ends}]*(?:{b})")) for a, b in pairs] for n, (_, _, pairs) in self.sides.items()}
        self.line = re.compile(f"[{ends}]")
        self.over = test(f"\\A[\\s\\S]{{1,{self.reach}}}(?:{states['diagnostic']})")
        self.actions = {a: test(p) for a, p in actions.items()}
        self.results = {r: test(p) for r, p in results.items()}
        self.own = test(own)

    def result(self, text: str) -> str:
        return "unknown" if not text else next((r for r, p in self.results.items() if p.search(text)), "attempted")


def fresh() -> dict:
    """The state of a conversation without messages."""
    return {"messages": 0, "items": 0, "failures": 0, "tail": {"customer": running.START, "support": running.START}, "said": {"customer": 0, "support": 0}, "head": "", "flags": {}, "open": {}, "waiting": []}


def step(c: dict, p: Patterns, message_id: str, role: str, text: str) -> list[dict]:
    """Take one more message into ``c``; the rows that it settles. What was open until it, then its own."""
    out = []
    for held in c["waiting"]:  # support's advice of the message before
        out.append({**held, "kind": "item", "result": p.result(text if role == "customer" else "")})
    c["waiting"] = []
    pos, n = c["messages"], p.reach
    c["messages"] += 1
    piece = text if c["said"][role] == 0 else f" {text}"
    c["said"][role] += 1
    tail = c["tail"][role]
    near = tail + piece
    for name, (r, _, _) in p.sides.items():
        if r != role:
            continue
        hit = any(x.search(near) for x in p.found[name])
        for k, (width, opens, ends) in enumerate(p.open[name]):
            key = f"{name}/{k}"
            hit = hit or (c["open"].get(key, False) and bool(ends.search(tail[-width - 1 :] + piece)))
            short = near[: max(len(near) - width, 0)]
            if opens.search(short):
                c["open"][key] = True
            elif p.line.search(short) or tail.startswith(running.START):
                c["open"][key] = False
        c["flags"][name] = c["flags"].get(name, False) or hit
    c["tail"][role] = near[-n:]
    if role == "support" and len(c["head"]) < n:
        c["head"] = (c["head"] + piece)[:n]
    for action, x in p.actions.items():
        if x.search(text):
            c["items"] += 1
            item = {"pos": pos, "item": c["items"], "message_id": message_id, "action": action, "explicitness": "explicit" if role == "support" or p.own.search(text) else "inferred"}
            if role == "support":
                c["waiting"].append(item)
            else:
                out.append({**item, "kind": "item", "result": p.result(text)})
    if role == "customer":
        c["failures"] += bool(p.now["failure"].search(text))
        found = {name: c["flags"].get(name, False) for name in p.sides} | {name: bool(p.now[name].search(text)) for name in state.SAID_NOW}
        met = c["tail"]["customer"].rjust(n, running.START) + " " + c["head"]
        found["diagnostic"] = found["diagnostic_customer"] or found["diagnostic_support"] or bool(p.over.search(met))
        out.append({"kind": "state", "pos": pos, "message_id": message_id, "state": STATES[decided(found, c["failures"])]})
    return out


def decided(found: dict[str, bool], failures: int) -> int:
    """Number of the state, as ``state.decided`` has it for cases without a given ledger."""
    order = (
        (found["investigation"], 6), (found["private_channel"] and found["account_word"], 5), (found["access_risk"], 5), (found["resolved"], 7), (found["improving"], 8), (failures >= 2, 4),
        (failures == 1 or found["result"], 3), (found["proposal"], 2), (not found["platform"] or not found["symptom"], 0), (found["diagnostic"], 1),
    )
    return next((s for holds, s in order if holds), 0)


def _rows(rows: list[dict]) -> pd.DataFrame:
    """Plain Python values in every column, as Spark's conversion wants them."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in COLUMNS})


class Tracker(StatefulProcessor):
    def __init__(self, gap_ms: int, states: dict[str, str], actions: dict[str, str], results: dict[str, str], own: str):
        self.gap, self.tables = gap_ms, (states, actions, results, own)

    def init(self, handle) -> None:
        self.handle, self.patterns = handle, Patterns(*self.tables)
        self.case = handle.getValueState("case", "held string, last long")
        self.early = handle.getMapState("early", "at long, message_id string", "role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names that Spark calls
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = int(r.ts.value // 1_000)  # microseconds
                self.early.updateValue((at, r.message_id or ""), (r.role, r.text or ""))
                self.handle.registerTimer(at // 1_000 + 1)
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k for k in self.early.keys() if k[0] // 1_000 + 1 <= until)
        held, last = self.case.get() if self.case.exists() else (None, None)
        c, out = json.loads(held) if held else fresh(), []
        for k in due:
            role, text = self.early.getValue(k)
            out += step(c, self.patterns, k[1], role, text)
            self.early.removeKey(k)
            last = k[0] // 1_000
        if due:
            self.case.update((json.dumps(c), last))
            self.handle.registerTimer(last + self.gap)
        elif last is not None and last + self.gap <= until and not any(True for _ in self.early.keys()):
            out += [{**item, "kind": "item", "result": "unknown"} for item in c["waiting"]]
            out.append({"kind": "closed", "messages": c["messages"]})
            self.case.clear()
        yield _rows([{"conversation_id": key[0], **r} for r in out])

    def close(self) -> None:
        pass


def track(messages: DataFrame, late: str = "10 minutes", gap: timedelta = timedelta(hours=2), states: dict[str, str] = STATE_PATTERNS, actions: dict[str, str] | None = None, results: dict[str, str] = RESULT_PATTERNS, own: str = OWN_ATTEMPT) -> DataFrame:
    """Rows of all conversations of a stream of (conversation_id, message_id, role, text, ts)."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    tracker = Tracker(int(gap.total_seconds() * 1000), states, ledger.action_patterns() if actions is None else actions, results, own)
    held = messages.select("conversation_id", "message_id", "role", "text", "ts").withWatermark("ts", late)
    return held.groupBy("conversation_id").transformWithStateInPandas(tracker, OUT, "Append", "EventTime")
