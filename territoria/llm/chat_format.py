"""Chat formatting by token-level assembly.

Each turn's text is encoded by itself; ids reserved above the vocabulary are spliced
in as turn marks, so no text can ever encode to a mark.  The loss mask is the prefix
sum of +1 after an assistant's opening mark and -1 at its closing mark.  Control
strings that occur inside a text are escaped as well, so that the rendered string is
as unambiguous as the ids: one backslash is put after the first character (and
before any backslashes already there), and taken out again on reading.

`assemble` works on each turn in the scan's task.  `read_back` streams the sorted
turns of a conversation through the digests, holding one turn at a time, so a
conversation of any length needs bounded memory.  A digest over a conversation is
sequential by nature: the assembled ids of one conversation are read by one task,
while encoding and masking are spread over all.

Defined cases: a null text is empty, a null role is the empty role; other roles than
the three marked ones are carried as text between role marks; turns are ordered by
(turn, ids) with null turns first; a null conv_id is a conversation of its own;
repeated rows stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import encode_text, text_udf

#: The template's control strings.
MARKS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
#: role -> (opening, closing) mark; any other role is written [ROLE]role[/ROLE]text[/TURN].
TEMPLATE = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}

_CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|/?ROLE\]|/TURN\])"
#: The same with at least one backslash: what an escaped text holds.
_ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/?s>|</?SYS>>|/?ROLE\]|/TURN\])"
_FIND, _FIND_ESCAPED = re.compile(_CONTROL), re.compile(_ESCAPED)


def escape(text: str) -> str:
    return _FIND.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _FIND_ESCAPED.sub(r"\1\2\3", text)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    """The encoding and the id of every mark, reserved above the vocabulary."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return enc, {m: max(ranks.values()) + 1 + i for i, m in enumerate(MARKS)}


def assemble(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, ids, loss_mask (0/1 per id), n_chars of the rendered turn."""
    def run(rows: list) -> list:
        enc, mark = _encoding(path, pattern)
        out = []
        for role, text in rows:
            role, text = role or "", escape(text or "")
            body = encode_text(enc, text)
            if role in TEMPLATE:
                head, (opening, closing) = [], TEMPLATE[role]
                ids = [mark[opening], *body, mark[closing]]
                n_chars = len(opening) + len(text) + len(closing)
            else:
                shown = escape(role)
                head, closing = encode_text(enc, shown), "[/TURN]"
                ids = [mark["[ROLE]"], *head, mark["[/ROLE]"], *body, mark[closing]]
                n_chars = len("[ROLE][/ROLE]") + len(shown) + len(text) + len(closing)
            step = np.zeros(len(ids), np.int8)
            if role == "assistant":
                step[1] += 1
                step[len(ids) - 1] -= 1
            out.append({"ids": ids, "loss_mask": np.cumsum(step).tolist(), "n_chars": n_chars})
        return out

    made = text_udf(run, "struct<ids: array<int>, loss_mask: array<tinyint>, n_chars: bigint>")(F.array(turns["role"], turns["text"]))
    return turns.select(turns["conv_id"], turns["turn"], made.alias("_m")).select("conv_id", "turn", "_m.*")


def read_turn(ids: list[int], mask: list[int], enc, mark: dict[str, int]) -> tuple[str, str, str]:
    """(role, text, text under the loss mask), from ids and mask alone."""
    names = {i: m for m, i in mark.items()}
    opening = names[ids[0]]
    if opening == "[ROLE]":
        cut = ids.index(mark["[/ROLE]"])
        role, body = unescape(enc.decode(ids[1:cut])), ids[cut + 1:-1]
    else:
        role, body = next(r for r, (o, _) in TEMPLATE.items() if o == opening), ids[1:-1]
    under = [i for i, m in zip(ids, mask, strict=True) if m]
    return role, unescape(enc.decode(body)), unescape(enc.decode(under))


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    def run(batches):
        enc, mark = _encoding(path, pattern)
        state, key = None, None

        def row(key, s):
            return {"conv_id": key, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2],
                    "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4]}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != key:
                    if state is not None:
                        done.append(row(key, state))
                    key, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, under = read_turn(r["ids"], r["loss_mask"], enc, mark)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += r["n_chars"]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(key, state)], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    rows = formatted.select(F.col("conv_id").cast("long"), "turn", "ids", "loss_mask", "n_chars")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
