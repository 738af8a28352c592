"""Name look-ups against testing all pairs, and what their plans send where."""

import re

import pytest

from chatlake.operators import filters
from chatlake.session import durable

NAMES = ["Ann Lee", "Anna", None, "ann-marie the very long-named one of the north", "Ån", "a", "Bob 5550001", "bobob"]
VALUES = ["ann", "AN", "a", "b", "bob", "555", "5550", "+1 555", "zzz", "", "long-named one of the north", "ann-marie the very long-named one of the north",
          "ann-marie the very long-named one of the south", "5550 001"]


@pytest.fixture(scope="module")
def tables(spark):
    people = [(i, f"+1555000{i}", NAMES[i % len(NAMES)], f"1555000{i}" if i % 3 else None) for i in range(24)]
    handles = spark.createDataFrame(people, "handle_id long, address string, name string, digits string")
    chats = spark.createDataFrame([(i, n, "Bob's" if i == 3 else None) for i, n in enumerate(NAMES)], "chat_id long, title string, display_name string")
    return people, durable(handles), durable(chats), spark.createDataFrame([(v,) for v in VALUES], "value string")


def contained(people):
    out = set()
    for value in VALUES:
        needle, digits = value.strip().lower(), re.sub("[^0-9]", "", value)
        for key, address, name, form in people:
            if needle and (needle in (name or "").lower() or needle in address or (len(digits) >= 4 and digits in (form or ""))):
                out.add(("person", value, key))
        for key, title in enumerate(NAMES):
            if needle and (needle in (title or "").lower() or (key == 3 and needle in "bob's")):
                out.add(("chat", value, key))
    return out


@pytest.mark.parametrize("few", [0, 12, 10_000])
def test_against_all_pairs(tables, monkeypatch, few):
    people, handles, chats, values = tables
    monkeypatch.setattr(filters.contains_join, "__defaults__", (few,))
    got = filters.match_names(values, handles, chats).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == contained(people)


def subtrees(plan, operator):
    """The lines below every ``operator`` of a plan."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if operator in line:
            below = [k for k in range(i + 1, len(lines))]
            end = next((k for k in below if depth[k] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


def test_cut_fields_are_never_broadcast(tables):
    """A stored table of names is small for the planner, its pieces are not: one broadcast of them filled the driver."""
    _, handles, chats, values = tables
    plan = filters.match_names(durable(values), handles, chats)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
    assert not any("Generate" in below for below in subtrees(plan, "BroadcastExchange"))
