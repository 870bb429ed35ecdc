r"""Chat formatting on the level of tokens.

A turn is a reserved id that opens it by role, its text, and a reserved id that closes it; roles
other than system, user and assistant are spelled between two reserved ids. Texts are encoded
on their own, so no token spans a marker, and reserved ids lie beyond the vocabulary, so no text
can produce one. The loss mask is a prefix sum: +1 where an assistant's text begins, -1 at its
end.

Control strings inside texts are escaped, so the formatted text too can be read back: every
backslash is doubled and a backslash goes in after the first character of a control string.
Taking each backslash out and the character after it as it is reverses this.

Every turn is a row of the output with its token offset, so a conversation of any length is never
one row. Turns go in order of ``turn`` (null first), then role and text; equal rows are turns each.
Null roles and texts count as empty. A null conversation id is a conversation of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rotamera.llm.bpe import load_ranks

# fixed values: markers of the template in order of their reserved ids
MARKERS = ("<|system|>", "<|user|>", "<|assistant|>", "<|role|>", "<|text|>", "<|end|>")
# fixed values: control strings of common chat templates
CONTROLS = (*MARKERS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
SYSTEM, USER, ASSISTANT, ROLE, TEXT, END = range(len(MARKERS))
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}


def escape(text: str, pattern) -> str:
    return pattern.sub(lambda m: m[0] * 2 if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def control_pattern():
    import re
    return re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))


def unescape(text: str) -> str:
    import re
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _library(ranks: dict[bytes, int], pattern: str):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def formatted(turns: DataFrame, ranks_path: str, pattern: str, conv: str = "conv_id",
              turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv, n (position in the conversation), ids, start (tokens of the
    conversation before it), loss_from and loss_to (its stretch under the loss mask, empty
    unless an assistant's), formatted (its text with markers)."""
    spark = turns.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    kind = "struct<ids:array<int>,body:int,formatted:string>"

    @F.arrow_udf(kind)
    def assemble(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        enc = _library(ranks.value, pattern).encode_ordinary
        base, controls = len(ranks.value), control_pattern()
        out = pa.struct([("ids", pa.list_(pa.int32())), ("body", pa.int32()),
                         ("formatted", pa.string())])
        for roles, texts in parts:
            rows = []
            for r, t in zip(roles.to_pylist(), texts.to_pylist()):
                r, t = r or "", escape(t or "", controls)
                body = enc(t)
                if r in ROLES:
                    head, shown = [base + ROLES[r]], MARKERS[ROLES[r]]
                else:
                    r = escape(r, controls)
                    head = [base + ROLE, *enc(r), base + TEXT]
                    shown = MARKERS[ROLE] + r + MARKERS[TEXT]
                rows.append({"ids": [*head, *body, base + END], "body": len(body),
                             "formatted": shown + t + MARKERS[END]})
            yield pa.array(rows, out)
    one = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"),
                       F.coalesce(role, F.lit("")).alias("_r"),
                       F.coalesce(text, F.lit("")).alias("_x"))
    one = one.select("_c", "_t", "_r", F.xxhash64("_x").alias("_h"),
                     assemble(F.col("_r"), F.col("_x")).alias("_s"))
    order = W.partitionBy("_c").orderBy("_t", "_r", "_h", "_s.formatted")
    size = F.size("_s.ids")
    upto = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    loss = F.when(F.col("_r") == "assistant", F.col("_s.body")).otherwise(0)
    return one.select(
        F.col("_c").alias(conv), (F.row_number().over(order) - 1).cast("long").alias("n"),
        F.col("_s.ids").alias("ids"), (upto - size).alias("start"),
        (upto - 1 - loss).alias("loss_from"), (upto - 1).alias("loss_to"),
        F.col("_s.formatted").alias("formatted"))


def read_back(rows: DataFrame, ranks_path: str, conv: str = "conv_id") -> DataFrame:
    """Digests of conversations read from formatted rows: conv, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_tokens. Rows stream through in order, and only
    running hashes are held for a conversation."""
    spark = rows.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    kind = dict(rows.dtypes)[conv]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        vocab = {r: t for t, r in ranks.value.items()}
        base, names = len(vocab), list(ROLES)
        at, state, done, id_type = None, None, [], None

        def words(ids):
            return unescape(b"".join([vocab[i] for i in ids]).decode())

        def close():
            turns, loss = state[1].hexdigest(), state[3].hexdigest()
            done.append((at, state[0], turns, state[2], loss, state[4], state[5]))

        def batch():
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *[pa.array(c) for c in cols[1:]]],
                ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                 "formatted_chars", "n_tokens"])
        for b in batches:
            id_type = b.column("conv").type
            ids = b.column("ids")
            flat, cuts = ids.values.to_numpy(), ids.offsets.to_numpy()
            # the mask of a batch: +1 at the start of each stretch, -1 at its end, summed up
            step = np.zeros(len(flat) + 1, np.int8)
            starts, froms, tos = (b.column(c).to_numpy() for c in ("start", "loss_from", "loss_to"))
            here = cuts[:-1] - starts
            np.add.at(step, here + froms, 1)
            np.add.at(step, here + tos, -1)
            mask = np.cumsum(step[:-1]) > 0
            for conv_id, lo, hi, shown in zip(b.column("conv").to_pylist(), cuts[:-1].tolist(),
                                              cuts[1:].tolist(), b.column("chars").to_pylist()):
                if state is None or conv_id != at:
                    if state is not None:
                        close()
                        if len(done) >= 10_000:
                            yield batch()
                            done = []
                    at, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                t = flat[lo:hi].tolist()
                if t[0] == base + ROLE:
                    split = t.index(base + TEXT)
                    role, body = words(t[1:split]), t[split + 1:-1]
                else:
                    role, body = names[t[0] - base], t[1:-1]
                said = words(body)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                under = words(flat[lo:hi][mask[lo:hi]].tolist())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += shown
                state[5] += hi - lo
        if state is not None:
            close()
        if done:
            yield batch()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select(F.col(conv).alias("conv"), "n", "ids", "start", "loss_from", "loss_to",
                        F.length("formatted").cast("long").alias("chars"))
            .repartition(parts, "conv").sortWithinPartitions("conv", "n")
            .mapInArrow(read, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                              "loss_sha256 string, formatted_chars long, n_tokens long")
            .withColumnRenamed("conv", conv))
