"""A made-up history of a garden co-operative from a seeded generator: chatter about tools, and some planted messages."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from chatlake import schemas
from chatlake.functions.times import SOURCE_EPOCH_MICROS
from chatlake.sources.raw import Raw

START = datetime(2023, 6, 5, 6, 0, tzinfo=timezone.utc)
HOUR, DAY, MINUTE = timedelta(hours=1), timedelta(days=1), timedelta(minutes=1)
TOOLS = "bucket spade hose twine stake mulch tray bench rake hoe sieve barrow trowel gloves".split()
ENDS = "is missing|was lent out|needs care|looks fine|should be cleaned|got wet".split("|")

#: handle: address, name in the address book
PEOPLE = {
    1: ("+31 (20) 555-0101", "Mira Okafor"), 2: ("Lev@Plot.example", "Lev Santos"), 3: ("+31205550103", None),
    4: ("+316 5555 0104", "Priya Nilsson"), 5: ("tom@plot.example", None),
}
#: chat: name, members
CHATS = {51: (None, [1]), 52: ("", [2]), 53: ("Seed Swap", [1, 2, 3, 4]), 54: (" ", [2, 4, 5]), 55: (None, [3])}
#: planted: chat, sender (None: own), day, text
PLANTED = {
    "valve": (51, 1, 20, "the pump needs a valve, model KX-40"),
    "ordered": (53, None, 22, "valve for the pump is ordered"),
    "compost": (53, 3, 24, "compost delivery on thursday"),
    "seeds": (52, 2, 26, "catalogue at https://seeds.example/list"),
    "tomatoes": (54, 4, 28, "such ripe tomatoes"),
    "supper": (52, 2, 70, "harvest supper in the barn"),
    "greenhouse": (55, 3, 30, "take a picture of the greenhouse"),
    "reading": (53, 4, 32, "meter reading of the pump was high"),
}


def nanos(t: datetime) -> int:
    return (int(t.timestamp() * 1_000_000) - SOURCE_EPOCH_MICROS) * 1000


def address(handle: int) -> str:
    """An address as the source has it."""
    written = PEOPLE[handle][0]
    return written.lower() if "@" in written else "+" + "".join(c for c in written if c.isdigit())


def message(rowid, chat, sender, t, text, **more):
    """A source row and the chat it is linked to; ``sender`` None is oneself."""
    row = dict.fromkeys(f.split()[0] for f in schemas.RAW["message"].split(", "))
    row |= {"rowid": rowid, "guid": f"row-{rowid}", "text": text, "handle_id": sender or 0, "is_from_me": int(sender is None), "date": nanos(t)}
    row |= {"service": "x", "item_type": 0, "associated_message_type": 0, "date_edited": 0, "date_retracted": 0} | more
    return row, chat


def generate(seed: int = 77):
    """(messages in order of time, id of each planted message)."""
    rng = random.Random(seed)
    said = []
    for chat, (_, members) in CHATS.items():
        for day in sorted(rng.sample(range(19), 3)):
            t = START + day * DAY + rng.randrange(10) * HOUR
            for _ in range(rng.choice([2, 5, 19])):
                t += timedelta(seconds=rng.randrange(20, 900))
                said.append((t, chat, rng.choice([None, *members]), f"{rng.choice(TOOLS)} {rng.choice(ENDS)}", None))
    said += [(START + day * DAY + 12 * HOUR, chat, sender, text, name) for name, (chat, sender, day, text) in PLANTED.items()]
    said.sort(key=lambda s: s[:2])
    rows = [message(100 + k, chat, sender, t, text) for k, (t, chat, sender, text, _) in enumerate(said)]
    return rows, {s[4]: 100 + k for k, s in enumerate(said) if s[4]}


MESSAGES, IDS = generate()
CONTACTS = {written: name for written, name in PEOPLE.values() if name}
LAST_ID = MESSAGES[-1][0]["rowid"]


def window_starts(messages, gap=45 * MINUTE, max_bytes=900, max_messages=16):
    """Ids of the first messages of all windows, message by message."""
    starts, state = set(), {}
    who = lambda row: "Me" if row["is_from_me"] else PEOPLE[row["handle_id"]][1] or address(row["handle_id"])
    for row, chat in sorted(messages, key=lambda m: (m[0]["date"], m[0]["rowid"])):
        size = len(f"{who(row)}: {row['text']}".encode())
        last, n, used = state.get(chat, (None, 0, 0))
        if last is None or row["date"] - last > gap.total_seconds() * 1e9 or n >= max_messages or used + size > max_bytes:
            starts.add(row["rowid"])
            n, used = 0, 0
        state[chat] = row["date"], n + 1, used + size + 1
    return starts


def raw(spark, messages=None) -> Raw:
    messages = MESSAGES if messages is None else messages

    def frame(name, rows):
        names = [f.split()[0] for f in schemas.RAW[name].split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) if isinstance(r, dict) else r for r in rows], schemas.RAW[name])

    first = lambda members: address(members[0]) if len(members) == 1 else f"room-{len(members)}"
    return Raw(
        handle=frame("handle", [(h, address(h), "x") for h in PEOPLE]),
        chat=frame("chat", [(c, f"chat-{c}", first(members), "x", name) for c, (name, members) in CHATS.items()]),
        chat_handle_join=frame("chat_handle_join", [(c, h) for c, (_, members) in CHATS.items() for h in members]),
        message=frame("message", [m for m, _ in messages]),
        chat_message_join=frame("chat_message_join", [(c, m["rowid"]) for m, c in messages if c is not None]),
        attachment=frame("attachment", [(7, "/m/ripe.png", "image/png", "ripe.png", 50_321, 0, 0), (8, "/m/preview", None, None, 12, 0, 1)]),
        message_attachment_join=frame("message_attachment_join", [(IDS["tomatoes"], 7), (IDS["tomatoes"], 8)]),
    )


def contacts(spark):
    return spark.createDataFrame(list(CONTACTS.items()), "address string, full_name string")
