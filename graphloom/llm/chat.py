"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share tree nodes. A node is a turn after all
turns before it, named by a chained digest. Its tokens are emitted once, in depth-first
order, with position ids that count along the conversation; every conversation keeps the
intervals of the emitted stream that it attends to, one for each stretch of ancestors.

The tree is never gathered. Of the conversations that pass a node, the least owns it, so that
each conversation owns an end stretch of its turns, a chain, which hangs on a node of another
conversation's chain. A chain's sort key is its parent's key plus (deepest branch first,
name); sorting by keys is the depth-first order, and running sums give the places.

The template is ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end.
Inside roles and texts a ``<`` and ``|`` never meet: a backslash is put between them, one
more where there are some; roles also have their line ends escaped. Reading undoes this.

Edge cases: a null text or role is empty; rows are ordered by turn, then role and text, so
repeated turns stay apart; a null turn comes first; rows with a null conv_id are one
conversation; a very long text is one turn; a conversation of very many turns passes through one
task in order, as its digest has to, but is never held there; equal conversations share all nodes; an empty table gives an empty tree; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tokens import encoder
from graphloom.operators.skew import join_unique
from graphloom.session import materialize, shared_path, shuffle_width

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


_TURNS = "conv string, idx int, node binary, parent binary, loss boolean, ids binary, n long, mask_at long, mask_n long, pos long"


def _formatted(batches: Iterator[pa.RecordBatch], tokenizer: str | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, with their node and tokens; the state is one digest."""
    enc = encoder(tokenizer, literal_specials=True)
    conv, digest, idx, pos = None, b"", 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 5000):
            part = batch.slice(start, 5000)
            names, roles, texts = (part.column(c).to_pylist() for c in ("conv", "role", "text"))
            roles = [r or "" for r in roles]
            texts = [t or "" for t in texts]
            heads = enc.encode([f"{START}{escape_role(r)}\n" for r in roles])
            bodies = enc.encode([escape(t) for t in texts])
            tail = enc.encode([END + "\n"])[0]
            rows = []
            for name, role, text, head, body in zip(names, roles, texts, heads, bodies):
                if name != conv:
                    conv, digest, idx, pos = name, b"", 0, 0
                parent = digest
                raw = role.encode()
                digest = hashlib.blake2b(digest + len(raw).to_bytes(8, "big") + raw + text.encode(), digest_size=16).digest()
                ids = head + body + tail
                loss = role == LOSS_ROLE
                rows.append((name, idx, digest, parent, loss, ids, len(ids) // 4, len(head) // 4, len(body) // 4 if loss else 0, pos))
                idx += 1
                pos += len(ids) // 4
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in _TURNS.split(", ")])


@dataclass
class Tree:
    """``nodes``: emitted tokens in depth-first order. ``paths``: what each conversation attends to."""

    root: str

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/nodes")

    def paths(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/paths")


def _chains(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their node's owner, and one row per conversation: its branch and parent chain."""
    owners = turns.groupBy("node").agg(F.min("conv").alias("owner"))
    owned = materialize(join_unique(turns, owners, ["node"]), "chat-owned")
    own = F.col("owner") == F.col("conv")
    chains = owned.groupBy("conv").agg(
        F.count("*").cast("int").alias("turns"),
        F.sum("n").alias("tokens"),
        F.min(F.when(own, F.col("idx"))).alias("branch"),
        F.min(F.when(own, F.col("pos"))).alias("branch_pos"),
        F.max(F.when(~own, F.struct("idx", "owner"))).alias("up"),
    )
    chains = chains.select("conv", "turns", "tokens", "branch", "branch_pos", F.col("up.owner").alias("up"))
    return owned, materialize(chains, "chat-chains")


def _keys(chains: DataFrame) -> DataFrame:
    """Sort keys of all chains: the steps from the root down to each, by pointer jumping.

    Every chain holds the steps below the ancestor it points to; a round prepends the ancestor's
    own steps and takes over its pointer, so the number of rounds is the logarithm of the depth.
    """
    step = F.struct((-F.col("branch")).alias("deep"), F.col("conv"), F.col("branch_pos").alias("pos"))
    own = chains.filter("branch is not null")
    top = F.when(F.col("branch") > 0, F.col("up"))
    open_ = materialize(own.select("conv", top.alias("up"), F.array(step).alias("key")), "chat-keys")
    done = open_.filter("up is null").select("conv", "key")
    while True:
        waiting = open_.filter("up is not null")
        n = waiting.count()
        if not n:
            return done
        above = open_.select(F.col("conv").alias("up"), F.col("up").alias("next"), F.col("key").alias("up_key"))
        grown = join_unique(waiting, above, ["up"], n)
        grown = materialize(grown.select("conv", F.col("next").alias("up"), F.concat("up_key", "key").alias("key")), "chat-keys")
        # finished chains stay to be pointed at
        done = materialize(done.unionByName(grown.filter("up is null").select("conv", "key")), "chat-done")
        open_ = grown.filter("up is not null").unionByName(done.withColumn("up", F.lit(None).cast("string")), allowMissingColumns=True)


def _places(spark: SparkSession, keys: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv, start, own): where each chain begins in the depth-first stream."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.asarray(batch.column("own"))
            ends = at + np.cumsum(own)
            cols = [batch.column("conv"), batch.column("own"), pa.array(ends - own), pa.array(np.full(len(own), part))]
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays(cols, ["conv", "own", "local", "part"])

    sized = keys.join(chains.select("conv", (F.col("tokens") - F.col("branch_pos")).alias("own")), "conv")
    spread = sized.repartitionByRange(shuffle_width(spark), "key").sortWithinPartitions("key").select("conv", "own")
    local = materialize(spread.mapInArrow(running, "conv string, own long, local long, part long"), "chat-places")
    sums = sorted(tuple(r) for r in local.groupBy("part").agg(F.sum("own")).collect())  # one row a partition
    base, at = {}, 0
    for part, total in sums:
        base[part] = at
        at += total
    table = spark.createDataFrame(list(base.items()) or [(-1, 0)], "part long, base long")
    return local.join(F.broadcast(table), "part").select("conv", "own", (F.col("base") + F.col("local")).alias("start"))


def build(conversations: DataFrame, tokenizer: str | None = None) -> Tree:
    spark = conversations.sparkSession
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = conversations.select(name.alias("conv"), "turn", "role", "text")
    order = ["conv", "turn", "role", "text"]
    rows = rows.repartition(shuffle_width(spark), "conv").sortWithinPartitions(*order).select("conv", "role", "text")
    turns = materialize(rows.mapInArrow(lambda b: _formatted(b, tokenizer), _TURNS), "chat-turns")
    owned, chains = _chains(turns)
    keys = materialize(_keys(chains), "chat-keys")
    places = materialize(_places(spark, keys, chains), "chat-starts")

    tree = Tree(shared_path(spark, "chat"))
    own = owned.filter("owner = conv").select("conv", "idx", "loss", "ids", "n", "mask_at", "mask_n", "pos")
    own = own.join(chains.select("conv", "branch_pos"), "conv").join(places.select("conv", "start"), "conv")
    nodes = own.select("conv", "idx", (F.col("start") + F.col("pos") - F.col("branch_pos")).alias("dfs_start"), "n", "pos", "loss", "mask_at", "mask_n", "ids")
    nodes.repartitionByRange(shuffle_width(spark), "dfs_start").sortWithinPartitions("dfs_start").write.parquet(f"{tree.root}/nodes")

    # a conversation without a chain of its own follows its parent's to its own last turn
    base = chains.select("conv", "turns", "tokens", F.when(F.col("branch").isNull(), F.col("up")).otherwise(F.col("conv")).alias("chain"))
    keyed = join_unique(materialize(base, "chat-base"), keys.withColumnRenamed("conv", "chain"), ["chain"])
    spans = keyed.select("conv", "turns", "tokens", F.posexplode("key").alias("at", "hop"), F.col("key").alias("key"))
    after = F.try_element_at("key", F.col("at") + 2)
    spans = spans.select(
        "conv",
        "turns",
        "at",
        F.col("hop.conv").alias("owner"),
        (-F.col("hop.deep")).alias("from_idx"),
        F.coalesce(-after["deep"], F.col("turns")).alias("to_idx"),
        (F.coalesce(after["pos"], F.col("tokens")) - F.col("hop.pos")).alias("length"),
    )
    spans = materialize(spans, "chat-spans")
    placed = join_unique(spans, places.select(F.col("conv").alias("owner"), "start"), ["owner"])
    span = F.struct("at", "owner", "from_idx", "to_idx", "start", (F.col("start") + F.col("length")).alias("end"))
    paths = placed.groupBy("conv").agg(F.first("turns").alias("turns"), F.sort_array(F.collect_list(span)).alias("attends"))
    paths.write.parquet(f"{tree.root}/paths")
    return tree


def turns_of(spark: SparkSession, tree: Tree) -> DataFrame:
    """(conv, idx, ids, mask_at, mask_n) of every conversation, from the tree."""
    paths = tree.paths(spark)
    hop = paths.select("conv", F.explode("attends").alias("a"))
    need = hop.select(F.col("conv").alias("reader"), F.col("a.owner").alias("conv"), F.explode(F.sequence("a.from_idx", F.col("a.to_idx") - 1)).alias("idx"))
    return join_unique(materialize(need, "chat-need"), tree.nodes(spark).select("conv", "idx", "loss", "ids", "mask_at", "mask_n"), ["conv", "idx"])


def read(spark: SparkSession, tree: Tree, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation, decoded from the emitted tokens."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer, literal_specials=True).tokenizer
        text_of = lambda raw: tok.decode(np.frombuffer(raw, "<u4").tolist(), skip_special_tokens=False)
        conv, state = None, None

        def done():
            turns, n, chars, loss, loss_n = state
            row = (int(conv) if conv else None, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for reader, ids, loss, at, n in zip(*(batch.column(c).to_pylist() for c in ("reader", "ids", "loss", "mask_at", "mask_n"))):
                if reader != conv:
                    if state is not None:
                        yield done()
                    conv, state = reader, [hashlib.sha256(), 0, 0, hashlib.sha256(), 0]
                whole = text_of(ids)
                if not (whole.startswith(START) and whole.endswith(END + "\n")):
                    raise ValueError("a node is not one formatted turn")
                role, text = whole[len(START) : -len(END) - 1].split("\n", 1)
                state[0].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                state[1] += 1
                state[2] += len(whole)
                if loss:
                    masked = unescape(text_of(ids[4 * at : 4 * (at + n)]))
                    state[3].update(masked.encode())
                    state[4] += len(masked)
        if state is not None:
            yield done()

    rows = turns_of(spark, tree).select("reader", "idx", "ids", "loss", "mask_at", "mask_n")
    rows = rows.repartition(shuffle_width(spark), "reader").sortWithinPartitions("reader", "idx")
    return rows.mapInArrow(decode, schema)
