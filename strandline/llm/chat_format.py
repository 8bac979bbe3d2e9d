"""Chat formatting into prefix trees.

Conversations that share initial turns are merged: a depth-first walk of the tree of turns emits every node of it once,
in the whole table. A packed row holds a stretch of the walk: its text, and for each conversation the intervals of the
text that are its own and its ancestors' turns, which are what its tokens may attend to; position ids count along the
conversation, not along the walk. Where a stretch starts below turns that an earlier row has emitted, the row names
these nodes as its context, by id, and does not repeat them.

The walk is a sort. A conversation's path is the sequence of 128-bit hashes of its turns' prefixes, so sorting by path,
in range partitions, puts conversations with common beginnings side by side, however many there are of one beginning.
What a conversation shares with the one before it has been emitted; the rest of its turns are new nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat formats; fixed values. In texts they are broken by a backslash after their first character.
CONTROLS = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>")
_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_HEADER = re.compile(r"(?:[^\\\n]|\\.)*", re.S)
ID = 16  # bytes of a node's id
_TURN = re.compile(rf"{re.escape(START)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(END)}\n", re.S)
LEARNED = "assistant"
#: A packed row is closed at so many conversations or code points; what it has emitted is not emitted again.
PACK_CONVERSATIONS, PACK_CHARS = 256, 1_000_000


def escape(text: str) -> str:
    """text without control strings; unescape() gives it back."""
    return _BREAK.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn(role: str, text: str) -> str:
    return f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2)), m.start(2), m.end(2)))
        at = m.end()
    return out


WALK = "_part int, _seq long, _shared int, _conv long, _path binary, _roles array<string>, _texts array<string>"
PACKED = (
    "pack string, text string, context array<struct<id:binary,position:long,length:long>>, "
    "nodes array<struct<id:binary,start:long,end:long,position:long,parent:int,role:string,loss_start:long,loss_end:long>>, conversations array<struct<conv_id:long,nodes:array<int>>>"
)


def path_of(roles: list[str], texts: list[str]) -> bytes:
    """The ids of a conversation's nodes, one after another: each a hash of the id before, the role and the text."""
    out, last = [], b""
    for r, t in zip(roles, texts, strict=True):
        r = r.encode("utf-8", "surrogatepass")
        last = hashlib.blake2b(b"%s%d:%s%s" % (last, len(r), r, t.encode("utf-8", "surrogatepass")), digest_size=ID).digest()
        out.append(last)
    return b"".join(out)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many initial nodes two paths have in common."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + ID] == b[k : k + ID]:
        k += ID
    return k // ID


def _walk(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """WALK: conversations in the order of the walk, with the number of turns each shares with the one before it."""
    c = turns.select(F.col(conv).cast("long").alias("_conv"), F.struct(F.col(order).alias("o"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).alias("_turn"))
    c = c.groupBy("_conv").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    c = c.select("_conv", F.transform("_turns", lambda x: x["r"]).alias("_roles"), F.transform("_turns", lambda x: x["t"]).alias("_texts"))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["_path"] = [path_of(list(r), list(t)) for r, t in zip(b["_roles"], b["_texts"], strict=True)]
            b["_conv"] = b["_conv"].astype("Int64")
            yield b

    c = c.mapInPandas(named, "_conv long, _roles array<string>, _texts array<string>, _path binary")
    c = c.repartitionByRange("_path", "_conv").sortWithinPartitions("_path", "_conv")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            b["_part"], b["_seq"], b["_conv"] = part, range(n, n + len(b)), b["_conv"].astype("Int64")
            paths = [last, *b["_path"]]
            b["_shared"] = [-1 if x is None else shared_turns(x, y) for x, y in zip(paths, paths[1:], strict=False)]
            last, n = paths[-1], n + len(b)
            yield b

    walk = written(c.mapInPandas(compared, WALK), "chat-walk")
    ends = walk.groupBy("_part").agg(F.min_by("_path", "_seq").alias("first"), F.max_by("_path", "_seq").alias("last")).orderBy("_part").collect()  # a row per partition
    starts = {x["_part"]: shared_turns(bytes(y["last"]), bytes(x["first"])) for y, x in zip(ends, ends[1:], strict=False)}
    first = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in starts.items() for v in kv]), F.col("_part")), F.lit(0)) if starts else F.lit(0)
    return walk.withColumn("_shared", F.when(F.col("_shared") < 0, first).otherwise(F.col("_shared")))


def pack(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", conversations: int = PACK_CONVERSATIONS, chars: int = PACK_CHARS) -> DataFrame:
    """Packed rows of the prefix trees of all conversations.

    ``text``: a stretch of the walk. ``nodes``: each turn emitted in it, its id, its place in the text, its first position
    id (code points from the conversation's start; they run on from there), its parent, and the part under the loss mask,
    the text of an assistant's turn. ``context``: the nodes that the stretch starts below, emitted by earlier rows.
    ``conversations``: each one's path of nodes; a node attends to the nodes before it on the path (attention()). In
    parents and paths, 0 and up are the row's own nodes, -1 is none, and -2 - k is the context's k-th.

    Turns sort by ``order`` (nulls first), then role, then text. Null roles and texts are empty; a null conversation
    id is one conversation without an id. Repeated rows are turns of their own. Other columns play no part. An empty
    table gives an empty result. A long conversation is one row, worked on in time linear in its turns and text.

    A pack is closed at so many ``conversations`` or ``chars``. Turns are told apart by 128-bit hashes.
    """
    walk = _walk(turns, conv, order, role, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, after = None, None
        for b in batches:
            for part, seq, i, path, shared, roles, texts in zip(b["_part"], b["_seq"], b["_conv"], b["_path"], b["_shared"], b["_roles"], b["_texts"], strict=True):
                if state is not None and (len(state.conversations) >= conversations or state.size >= chars or (part, seq) != after):
                    yield state.row()
                    state = None
                after = part, seq + 1  # a task may read files of the walk that are no neighbours
                state = state or _Pack(path, shared, roles, texts)
                state.add(None if pd.isna(i) else int(i), path, shared, list(roles), list(texts))
        if state is not None:
            yield state.row()

    return walk.mapInPandas(run, PACKED)


class _Pack:
    """A stretch of the walk in the making. Conversations come in order of their paths, so only the last one's path is open."""

    def __init__(self, path: bytes, shared: int, roles: list[str], texts: list[str]) -> None:
        self.parts, self.size, self.nodes, self.conversations, self.context, self.open, self.name = [], 0, [], [], [], [], hashlib.blake2b(digest_size=ID)
        at = 0
        for k in range(shared):
            n = len(turn(roles[k], texts[k]))
            self.context.append({"id": path[k * ID : (k + 1) * ID], "position": at, "length": n})
            at += n
            self.open.append((-2 - k, at))

    def add(self, conv: int | None, path: bytes, shared: int, roles: list[str], texts: list[str]) -> None:
        del self.open[shared:]
        at = self.open[-1][1] if self.open else 0
        for k in range(shared, len(roles)):
            t = turn(roles[k], texts[k])
            body = self.size + t.index("\n", _HEADER.match(t, len(START)).end()) + 1
            learned = roles[k] == LEARNED
            self.nodes.append({
                "id": path[k * ID : (k + 1) * ID], "start": self.size, "end": self.size + len(t), "position": at, "parent": self.open[-1][0] if self.open else -1, "role": roles[k],
                "loss_start": body if learned else self.size, "loss_end": self.size + len(t) - len(END) - 1 if learned else self.size,
            })
            self.parts.append(t)
            self.size, at = self.size + len(t), at + len(t)
            self.open.append((len(self.nodes) - 1, at))
        self.conversations.append({"conv_id": conv, "nodes": [n for n, _ in self.open]})
        self.name.update(f"{conv}:".encode() + path[-ID:])

    def row(self) -> pd.DataFrame:
        return pd.DataFrame({"pack": [self.name.hexdigest()], "text": ["".join(self.parts)], "context": [self.context], "nodes": [self.nodes], "conversations": [self.conversations]})


def attention(row, node: int) -> list[tuple[bytes | None, int, int]]:
    """What a node's tokens may attend to, besides what stands before them in the node: intervals (None, start, end) of the
    row's own text, and (id, 0, length) for nodes of its context."""
    out = []
    while (node := row["nodes"][node]["parent"] if node >= 0 else (node + 1 if node < -2 else -1)) != -1:
        own = row["nodes"][node] if node >= 0 else None
        out.append((None, own["start"], own["end"]) if own else (row["context"][-2 - node]["id"], 0, row["context"][-2 - node]["length"]))
    return out[::-1]


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _tails(packed: DataFrame) -> DataFrame:
    """(id, part, loss_start, loss_end) of the nodes that are open at the end of each row, with their text: those that later rows may have as context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, nodes, convs in zip(b["text"], b["nodes"], b["conversations"], strict=True):
                own = [nodes[i] for i in convs[-1]["nodes"] if i >= 0]
                out += [(n["id"], text[n["start"] : n["end"]], n["loss_start"] - n["start"], n["loss_end"] - n["start"]) for n in own]
            yield pd.DataFrame(out, columns=["id", "part", "loss_start", "loss_end"])

    return packed.select("text", "nodes", "conversations").mapInPandas(run, "id binary, part string, loss_start long, loss_end long")


def read_back(packed: DataFrame) -> DataFrame:
    """Each conversation, read from the packed rows by its intervals and contexts, as the digests of the contract."""
    packed = written(packed, "chat-packs")
    need = packed.select("pack", F.posexplode("context").alias("k", "c")).select("pack", "k", F.col("c.id").alias("id"))
    held = need.join(_tails(packed), "id").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("k", "part", "loss_start", "loss_end"))).alias("held"))  # a path per pack
    whole = packed.join(held, "pack", "left").select("text", "nodes", "conversations", "held")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, nodes, convs, held in zip(b["text"], b["nodes"], b["conversations"], b["held"], strict=True):
                for c in convs:
                    own = [(text[n["start"] : n["end"]], n["loss_start"] - n["start"], n["loss_end"] - n["start"]) if i >= 0 else (n["part"], n["loss_start"], n["loss_end"]) for i in c["nodes"] for n in [nodes[i] if i >= 0 else held[-2 - i]]]
                    formatted = "".join(t for t, _, _ in own)
                    turns = parse(formatted)
                    loss = "".join(unescape(t[x:y]) for t, x, y in own)
                    told = hashlib.sha256()
                    for role, t, _, _ in turns:
                        told.update(f"{role}\n{t}\n".encode())
                    out.append((c["conv_id"], len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            f = pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")])
            f["conv_id"] = f["conv_id"].astype("Int64")
            yield f

    return whole.mapInPandas(run, READ)
