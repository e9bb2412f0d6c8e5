"""Conversations as a prefix tree of token ids.

A turn is formatted as ``### role: text </turn>`` and a line end; control
strings inside roles and texts are escaped with a backslash. Conversations that
begin with the same turns share the nodes of those turns. The tree is emitted
depth-first, each node once, with the place of its tokens in the stream, their
position ids and the intervals of the stream that hold its ancestors, so that
attention can be limited to them.

The smallest conversation id below a node owns it. A child with its parent's
owner comes first, so the nodes that a conversation owns are one run of the
stream, and the order of these runs follows from the depths at which owners
change. Conversations are read turn by turn, never collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.llm.encoding import BYTE_BPE, encoder
from lexisieve.operators.index import running_sums
from lexisieve.session import materialize

_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): (.*) </turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_IN_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, escaped text and end of a turn."""
    return f"### {escape(role, True)}: ", escape(text), " </turn>\n"


def parse_turn(formatted: str) -> tuple[str, str]:
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def _by_conversation(df: DataFrame, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Run ``step(key, rows, state)`` over the ordered rows of each conversation.

    A conversation's rows come in one or several calls with the same ``state``
    dictionary; ``rows`` is None once, at its end. Calls return lists of output tuples.
    """
    names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            out = []
            keys = frame["conv_id"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if state is None or keys[a] != current:
                    if state is not None:
                        out += step(current, None, state)
                    current, state = keys[a], {}
                out += step(current, frame.iloc[a:b].itertuples(index=False), state)
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(step(current, None, state), columns=names)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInPandas(run, schema)


def prefix_tree(turns: DataFrame, vocabulary: str = BYTE_BPE, learns: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """The tree's nodes and the members of each conversation, both written to the shared folder.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. Nodes: ``owner``,
    ``depth`` (with it the key), ``start`` (tokens of the stream before it),
    ``position`` (position id of its first token), ``ids``, ``loss_from`` and
    ``loss_to`` (tokens of it under the loss mask) and ``ancestors`` (stream
    intervals of the earlier turns, in order). Members: ``conv_id``, ``depth``, ``owner``.

    Turns are ordered by turn (null first), role and text; a null role or text
    is an empty one; a repeated row is a turn of its own; rows without a
    conversation id are left out; an empty table gives an empty tree.
    """
    given = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def tokenise(key, rows, state):
        out = []
        if rows is None:
            return out
        rows = list(rows)
        pieces = [piece for row in rows for piece in format_turn(row.role, row.text)]
        ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in encoder(vocabulary, literal=True).encode(pieces)]
        for k, row in enumerate(rows):
            head, text, end = ids[3 * k:3 * k + 3]
            chain = hashlib.blake2b(state.get("chain", b""), digest_size=16)
            for part in (row.role, row.text):
                data = part.encode()
                chain.update(len(data).to_bytes(8, "little") + data)
            depth = state.get("depth", 0)
            state |= {"chain": chain.digest(), "depth": depth + 1}
            loss = (len(head), len(head) + len(text)) if row.role == learns else (0, 0)
            out.append((key, depth, state["chain"], np.concatenate((head, text, end)), *loss,
                        len(head) + len(text) + len(end)))
        return out

    rows = materialize(_by_conversation(
        given, ["turn", "role", "text"], tokenise,
        "conv_id long, depth int, prefix binary, ids array<int>, loss_from int, loss_to int, n int"))
    owners = rows.groupBy("prefix").agg(F.min("conv_id").alias("owner"))
    members = materialize(rows.select("conv_id", "depth", "prefix", "n").join(owners, "prefix").select(
        "conv_id", "depth", "owner", "n"))

    def branch(key, turns, state):
        if turns is None:
            own = state["total"] - state["pieces"][-1][2] if state["pieces"][-1][0] == key else 0
            ends = [*(p[2] for p in state["pieces"][1:]), state["total"]]
            return [(key, [{"back": -d, "owner": o} for o, d, _ in state["pieces"]], own,
                     [{"owner": o, "n": e - at} for (o, _, at), e in zip(state["pieces"], ends)])]
        pieces = state.setdefault("pieces", [])
        for row in turns:
            if not pieces or pieces[-1][0] != row.owner:
                pieces.append((row.owner, row.depth, state.get("total", 0)))
            state["total"] = state.get("total", 0) + row.n
        return []

    runs = _by_conversation(members, ["depth"], branch,
                            "conv_id long, branches array<struct<back:int,owner:long>>, own long, pieces array<struct<owner:long,n:long>>")
    runs = materialize(runs.where("own > 0"))
    placed = materialize(running_sums(runs.select("conv_id", "branches", "own"), ["branches"], {"end": F.col("own")}, unique=True)
                         .select(F.col("conv_id").alias("owner"), (F.col("end") - F.col("own")).alias("run")))
    # stream intervals of what comes before a run, in order
    before = runs.select("conv_id", F.posexplode("pieces").alias("k", "piece")).select(
        "conv_id", "k", "piece.*").where("owner <> conv_id").join(placed, "owner").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("k", F.col("run").alias("start"), (F.col("run") + F.col("n")).alias("end")))).alias("p"))
    heads = placed.join(before, F.col("owner") == F.col("conv_id"), "left").select(
        "owner", "run", F.coalesce(F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))),
                                   F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("p"))
    owned = members.where("conv_id = owner").select("conv_id", "depth", F.lit(True).alias("__owned"))
    nodes = rows.join(owned, ["conv_id", "depth"]).join(heads.withColumnRenamed("owner", "conv_id"), "conv_id").drop("prefix", "__owned")

    def place(key, turns, state):
        out = []
        for row in turns or ():
            start = state.get("at", row.run)
            inherited = [(x["start"], x["end"]) for x in row.p]
            shared = sum(b - a for a, b in inherited)
            own = [(row.run, start)] if start > row.run else []
            out.append((key, row.depth, start, shared + start - row.run, row.ids, row.loss_from, row.loss_to,
                        [{"start": a, "end": b} for a, b in inherited + own]))
            state["at"] = start + row.n
        return out

    tree = materialize(_by_conversation(
        nodes, ["depth"], place, "owner long, depth int, start long, position long, ids array<int>, loss_from int, "
        "loss_to int, ancestors array<struct<start:long,end:long>>"))
    return tree, members.select("conv_id", "depth", "owner")


def read_back(tree: DataFrame, members: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """Per conversation, decoded from its nodes: turns and their digest, the text
    under the loss mask (length and digest) and the formatted length."""
    def digest(key, nodes, state):
        if not state:
            state |= {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0}
        if nodes is None:
            return [(key, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])]
        decode = encoder(vocabulary, literal=True).library.decode
        for row in nodes:
            formatted = decode(list(row.ids), skip_special_tokens=False)
            role, text = parse_turn(formatted)
            state["turns"].update(f"{role}\n{text}\n".encode())
            learned = unescape(decode(list(row.ids[row.loss_from:row.loss_to]), skip_special_tokens=False))
            state["loss"].update(learned.encode())
            state["loss_chars"] += len(learned)
            state["chars"] += len(formatted)
            state["n"] += 1
        return []

    rows = members.join(tree.select("owner", "depth", "ids", "loss_from", "loss_to"), ["owner", "depth"])
    return _by_conversation(rows, ["depth"], digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                            "loss_sha256 string, formatted_chars long")
