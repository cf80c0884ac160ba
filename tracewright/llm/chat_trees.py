"""Chat formatting as prefix trees: a beginning that conversations share is emitted once.

Conversations are sorted by the hashes of their turns, so those with the same beginning lie side by
side, and cut into blocks of bounded size. In each block they are merged into a prefix tree whose
nodes are turns, numbered depth first. A node carries the position id of its first token (the tokens
of its ancestors come before it) and the intervals of the block's tokens that it attends to: its
ancestors and itself. A beginning that runs on from an earlier block, of the same task or not, is
emitted there alone: the later block has its nodes without tokens, marked as lent, with the key under
which the earlier block emits them, and a node attends to the whole of its lent ancestors. So no tree
grows with the corpus and every node's tokens stand in one block.

A turn reads ``<s>role\\ntext</s>``; control strings inside texts are escaped reversibly. The loss
mask covers the text of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import likely, release_memory, shuffle_partitions, worker_state, written
from .token_ids import tokenizer_path

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
RANKS = "byte_bpe_50k.tiktoken"
#: A block is closed once its conversations' texts have this many characters or this many members.
BLOCK_CHARS, BLOCK_MEMBERS = 1 << 19, 512
_TO_ESCAPE = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROLS)))


def escape(text: str) -> str:
    """Break control strings behind their first character with a backslash; double other backslashes."""
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what follows it."""
    return f"<s>{quote(role, safe='')}\n", escape(text), "</s>"


class Tokens:
    """Byte-level ids of ordinary text, and back."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()


def tokens(path: str) -> Tokens:
    return worker_state(("chat-tokens", path), lambda: Tokens(path))


Turns = list[tuple[str, str]]


def path_keys(turns: Turns) -> list[int]:
    """For each turn the key of the beginning that it ends: a chained hash as a signed number."""
    out, before = [], b""
    for role, text in turns:
        said = role.encode()
        before = hashlib.blake2b(before + len(said).to_bytes(8, "little") + said + text.encode(), digest_size=16).digest()
        out.append(int.from_bytes(before[:8], "little", signed=True))
    return out


def shared_length(a: Turns, b: Turns) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def build_block(conversations: list[tuple[int | None, Turns]], codec: Tokens, before: Turns = ()) -> dict:
    """Prefix tree of some conversations, emitted depth first. ``before``: the turns of the conversation before them.

    Node k has ``keys[k]``, ``parents[k]`` (-1: none), ``lent[k]``, its number of tokens ``sizes[k]``,
    token span ``starts[k]:ends[k]`` (empty for a lent node), first position id ``positions[k]``, loss
    span ``loss_starts[k]:loss_ends[k]`` (empty: no loss) and ``intervals[k]``. ``leaves`` gives the
    last node of each conversation (-1: no turns). The lent nodes come first.
    """
    children: list[dict[tuple[str, str], int]] = [{}]  # 0 is the root above the first turns
    turn: list[tuple[str, str]] = [("", "")]
    key = [0]
    last = []
    for _, turns in conversations:
        at = 0
        for t, k in zip(turns, path_keys(turns), strict=True):
            if t not in children[at]:
                children[at][t] = len(turn)
                turn.append(t)
                key.append(k)
                children.append({})
            at = children[at][t]
        last.append(at)
    lent, at = set(), 0
    for t in before[: shared_length(before, conversations[0][1])] if conversations else ():
        at = children[at][t]
        lent.add(at)
    out: dict = {k: [] for k in ("ids", "keys", "parents", "lent", "sizes", "starts", "ends", "positions", "loss_starts", "loss_ends", "intervals")}
    number, stack = {0: -1}, [(c, 0) for c in reversed(children[0].values())]
    while stack:
        node, above = stack.pop()
        k, parent = len(out["parents"]), number[above]
        number[node] = k
        head, body, tail = (codec.encode(x) for x in turn_parts(*turn[node]))
        start, size = len(out["ids"]), len(head) + len(body) + len(tail)
        given = node in lent
        if not given:
            out["ids"] += head + body + tail
        end, text_at = len(out["ids"]), start + len(head) * (not given)
        learned = turn[node][0] == "assistant" and not given
        above_spans = out["intervals"][parent] if parent >= 0 else []
        position = out["positions"][parent] + out["sizes"][parent] if parent >= 0 else 0
        for name, x in (("keys", key[node]), ("parents", parent), ("lent", given), ("sizes", size), ("starts", start), ("ends", end), ("positions", position), ("loss_starts", text_at), ("loss_ends", text_at + len(body) * learned)):
            out[name].append(x)
        # Spans that touch are one interval: a first child follows its parent directly.
        if given:
            joined = []
        elif above_spans and above_spans[-1][1] == start:
            joined = [*above_spans[:-1], (above_spans[-1][0], end)]
        else:
            joined = [*above_spans, (start, end)]
        out["intervals"].append(joined)
        stack += [(c, node) for c in reversed(children[node].values())]
    out["leaves"] = [number[x] for x in last]
    out["conv_ids"] = [c for c, _ in conversations]
    return out


def lend(block: dict, gone: set[int]) -> dict:
    """The block without the tokens of the nodes with these keys, which another block emits; ancestors of such nodes are among them."""
    out = {k: list(v) for k, v in block.items()}
    spans = sorted((block["starts"][k], block["ends"][k]) for k in range(len(block["keys"])) if block["keys"][k] in gone)
    starts, cut = [a for a, _ in spans], [0]
    for a, b in spans:
        cut.append(cut[-1] + b - a)

    def moved(place: int) -> int:
        """Where a token goes; one of a node that goes, to where that node was."""
        i = bisect_right(starts, place)
        return place - (cut[i] if not i or place >= spans[i - 1][1] else cut[i - 1] + place - spans[i - 1][0])

    out["ids"], at = [], 0
    for a, b in [*spans, (len(block["ids"]),) * 2]:
        out["ids"] += block["ids"][at:a]
        at = b
    for name in ("starts", "ends", "loss_starts", "loss_ends"):
        out[name] = [moved(x) for x in block[name]]
    out["lent"] = [x or k in gone for x, k in zip(block["lent"], block["keys"], strict=True)]
    out["intervals"] = [[(moved(a), moved(b)) for a, b in x if moved(a) < moved(b)] for x in block["intervals"]]
    return out


LISTS = {"ids": pa.int32(), "keys": pa.int64(), "parents": pa.int32(), "lent": pa.bool_(), "sizes": pa.int32(), "starts": pa.int32(), "ends": pa.int32(), "positions": pa.int32(), "loss_starts": pa.int32(), "loss_ends": pa.int32(), "leaves": pa.int32(), "conv_ids": pa.int64()}
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
KINDS = {name: pa.list_(kind) for name, kind in LISTS.items()} | {"intervals": pa.list_(pa.list_(SPAN)), "first_path": pa.list_(pa.int64()), "last_path": pa.list_(pa.int64())}
_SQL = {pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean"}
BLOCKS = "part int, block int, " + ", ".join(f"{name} array<{_SQL[kind]}>" for name, kind in LISTS.items()) + ", intervals array<array<struct<start:int,end:int>>>, first_path array<bigint>, last_path array<bigint>"


def _pairs(intervals: list[list[dict]]) -> list[list[tuple[int, int]]]:
    return [[(x["start"], x["end"]) for x in spans] for spans in intervals]


def _row(part: int, block: int, made: dict) -> pa.RecordBatch:
    arrays = [pa.array([part], pa.int32()), pa.array([block], pa.int32())]
    for name, kind in KINDS.items():
        value = [[{"start": a, "end": b} for a, b in x] for x in made[name]] if name == "intervals" else made[name]
        arrays.append(pa.array([value], kind))
    return pa.RecordBatch.from_arrays(arrays, names=["part", "block", *KINDS])


def format_trees(conversations: DataFrame, ranks: str, *, block_chars: int = BLOCK_CHARS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """Blocks of the conversations (rows conv_id, turn, role, text), as a written table.

    Turns are ordered by ``turn`` (nulls first), equal ones, such as repeated rows, by role and text.
    A null role or text is empty; rows without ``conv_id`` form one conversation. A single
    conversation must fit a task. Other columns are not read; an empty table has no blocks.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    n = shuffle_partitions(conversations.sparkSession)
    dealt = keyed.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, block = tokens(ranks), TaskContext.get().partitionId(), 0
        members, chars, before = [], 0, []

        def emit() -> pa.RecordBatch:
            paths = {"first_path": path_keys(members[0][1]) if not block else [], "last_path": path_keys(members[-1][1])}
            return _row(part, block, build_block(members, codec, before) | paths)

        for batch in batches:
            for conv, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append((conv, [(t["role"], t["text"]) for t in turns]))
                chars += sum(len(t["text"]) + len(t["role"]) + 8 for t in turns)
                if chars >= block_chars or len(members) >= block_members:
                    yield emit()
                    before, members, chars, block = members[-1][1], [], 0, block + 1
        if members:
            yield emit()
        release_memory()

    return written(_lend_across(written(dealt.mapInArrow(run, BLOCKS), "chat-parts")), "chat-blocks")


def _lend_across(blocks: DataFrame) -> DataFrame:
    """Beginnings that run on from an earlier part are emitted there alone; only a part's first path can have any."""
    last = Window.partitionBy("part").orderBy(F.desc("block"))
    ends = blocks.select("part", "block", "last_path").withColumn("r", F.row_number().over(last)).where("r = 1")
    ends = ends.select(F.col("part").alias("earlier"), F.explode("last_path").alias("k")).groupBy("k").agg(F.min("earlier").alias("earlier"))
    firsts = blocks.where("block = 0").select("part", F.explode("first_path").alias("key"))
    again = firsts.join(ends, (F.col("key") == F.col("k")) & (F.col("earlier") < F.col("part"))).groupBy("part").agg(F.collect_set("key").alias("gone"))
    gone = again.select(F.col("part").alias("p"), "gone")  # a path's keys a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                told = row.column(len(KINDS) + 2)[0].as_py()
                if not told:
                    yield pa.RecordBatch.from_arrays(row.columns[:-1], names=row.schema.names[:-1])
                    continue
                made = {name: row.column(name)[0].as_py() for name in KINDS}
                made["intervals"] = _pairs(made["intervals"])
                yield _row(row.column("part")[0].as_py(), row.column("block")[0].as_py(), lend(made, set(told)))

    told = F.when(F.col("block") == 0, F.col("gone")).alias("gone")
    return blocks.join(gone, F.col("part") == F.col("p"), "left").select(*blocks.columns, told).mapInArrow(run, BLOCKS)


def read_node(node: list[int], loss: list[int], codec: Tokens) -> tuple[tuple[str, str], str, int]:
    """Turn, unescaped text under the loss mask and formatted length of a node's tokens."""
    text = codec.decode(node)
    role, _, rest = text.removeprefix("<s>").partition("\n")
    return (unquote(role), unescape(rest.removesuffix("</s>"))), unescape(codec.decode(loss)), len(text)


def read_back(blocks: DataFrame, ranks: str) -> DataFrame:
    """Digest columns of every conversation in the blocks, from their tokens, positions and intervals.

    Lent nodes are fetched by key from the blocks that emit them. Position ids that do not count a
    node's ancestors, and intervals that are not its ancestors' tokens, raise an error.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    needed = ["ids", "keys", "parents", "lent", "sizes", "starts", "ends", "positions", "loss_starts", "loss_ends", "intervals", "leaves", "conv_ids"]
    def turn(x):
        cut = lambda a, b: F.slice("ids", x[a] + 1, x[b] - x[a])
        return F.struct(x["keys"].alias("key"), x["lent"].alias("lent"), cut("starts", "ends").alias("node"), cut("loss_starts", "loss_ends").alias("loss"))

    zipped = F.arrays_zip("keys", "lent", "starts", "ends", "loss_starts", "loss_ends")
    wanted = blocks.select("part", "block", F.explode(F.filter(F.arrays_zip("keys", "lent"), lambda x: x["lent"])["keys"]).alias("wanted"))
    keys = written(wanted.select(F.col("wanted").alias("w")).distinct(), "lent-keys")
    emitted = blocks.select(F.explode(F.transform(F.filter(zipped, lambda x: ~x["lent"]), turn)).alias("x")).select("x.key", "x.node", "x.loss")
    lenders = written(likely(emitted, "key", keys, "w").join(keys, F.col("key") == F.col("w")).select("key", "node", "loss"), "lent-turns")
    fetched = wanted.join(lenders, F.col("wanted") == F.col("key")).groupBy(F.col("part").alias("p"), F.col("block").alias("b")).agg(F.collect_list(F.struct("key", "node", "loss")).alias("given"))
    whole = blocks.join(fetched, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")), "left").select(*needed, "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens(ranks)
        for batch in batches:
            for i in range(batch.num_rows):
                block = dict(zip([*needed, "given"], (c[i].as_py() for c in batch.columns), strict=True))
                block["intervals"] = _pairs(block["intervals"])
                if rows := [(c, *told) for c, told in read_block(block, codec)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return whole.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same tokens in as few spans as may be."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        elif a < b:
            out.append((a, b))
    return out


def read_block(block: dict, codec: Tokens) -> Iterator[tuple[int | None, tuple]]:
    """Conversation and digests (turns, their hash, loss characters, their hash, formatted characters) of each member."""
    given = {x["key"]: (x["node"], x["loss"]) for x in block["given"] or ()}
    read, paths, done = [], [], {}
    for k, parent in enumerate(block["parents"]):
        span = (block["starts"][k], block["ends"][k])
        ids, loss = given[block["keys"][k]] if block["lent"][k] else (block["ids"][slice(*span)], block["ids"][block["loss_starts"][k] : block["loss_ends"][k]])
        read.append(read_node(ids, loss, codec))
        path = [*paths[parent], k] if parent >= 0 else [k]
        paths.append(path)
        if len(ids) != block["sizes"][k] or block["positions"][k] != sum(block["sizes"][x] for x in path[:-1]):
            raise ValueError("a position id does not count the tokens before its node")
        if not block["lent"][k] and _joined(block["intervals"][k]) != _joined([(block["starts"][x], block["ends"][x]) for x in path]):
            raise ValueError("an interval is not that of a node's ancestors")
    for conv, leaf in zip(block["conv_ids"], block["leaves"], strict=True):
        if leaf not in done:
            nodes = [read[k] for k in paths[leaf]] if leaf >= 0 else []
            told, loss = "".join(f"{role}\n{text}\n" for (role, text), _, _ in nodes), "".join(x for _, x, _ in nodes)
            done[leaf] = (len(nodes), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(n for _, _, n in nodes))
        yield conv, done[leaf]


def op9_chat_trees(spark, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_trees(rows.unionByName(more), ranks := tokenizer_path(RANKS)), ranks)
