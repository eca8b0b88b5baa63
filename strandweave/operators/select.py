"""Greedy choice of non-overlapping fragments of each read, with alternates and mapping-quality inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.seeds import check
from strandweave.operators._groups import per_group
from strandweave.params import Params

FRAGMENT_SCHEMA = (
    "read_id long, contig_id long, joint int, q_start long, q_end long, ref_start long, ref_end long, score double, anchor_count int, unique_anchors int, "
    "fragment_index int, alt_rank int, is_primary boolean, is_supplementary boolean, is_secondary boolean, f1 double, f2 double, m int"
)


def choose(q0: list[int], q1: list[int], r0: list[int], r1: list[int], score: list[float], anchors: list[int], p: Params) -> list[tuple[int, int, int, bool, float]]:
    """Fragments of one read from its chains, best score first: (chain, fragment, rank, is the best one, score of the next in its ladder).

    The score floor is a share of the best chain, even if that one fails the other floors. A
    chain that overlaps no accepted fragment by more than the tolerance is a fragment of its
    own; one that lies 80 % inside the first it overlaps is that fragment's alternate.
    """
    ladders: list[list[int]] = []
    for c in range(len(score)):
        host = next((x for x in ladders if min(q1[x[0]], q1[c]) - max(q0[x[0]], q0[c]) > p.overlap_tolerance), None)
        if host is None:
            if r1[c] - r0[c] >= p.min_ref_span and anchors[c] >= p.min_anchors and score[c] >= p.min_score_ratio * score[0]:
                ladders.append([c])
        elif anchors[c] >= p.min_anchors and max(0, min(q1[host[0]], q1[c]) - max(q0[host[0]], q0[c])) / max(1, q1[c] - q0[c]) >= 0.8:
            host.append(c)
    out = []
    for index, ladder in enumerate(sorted(ladders, key=lambda x: q0[x[0]])):
        for rank, c in enumerate(ladder[: 1 + p.secondary]):
            out.append((c, index, rank, ladder is ladders[0], score[ladder[rank + 1]] if rank + 1 < len(ladder) else 0.0))
    return out


def select_fragments(chains: DataFrame, params: Params | None = None) -> DataFrame:
    """Placements of every read; see FRAGMENT_SCHEMA. A read without an accepted chain has no row. Ties go by contig, strand and chain rank."""
    p = check(params)
    names = [x.split()[0] for x in FRAGMENT_SCHEMA.split(", ")]
    own = names[:10]

    def work(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        columns = [rows.column(c).to_pylist() for c in ("q_start", "q_end", "ref_start", "ref_end", "score", "anchor_count")]
        out = [(lo + c, *rest) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for c, *rest in choose(*[x[lo:hi] for x in columns], p)]
        if not out:
            return None
        at, index, rank, best, rival = (np.array(x) for x in zip(*out, strict=True))
        kept = rows.select(own).take(pa.array(at)).combine_chunks()
        i4 = lambda x: pa.array(x.astype(np.int32))
        top = rank == 0
        return pa.record_batch([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns], i4(index), i4(rank), pa.array(best & top), pa.array(~best & top), pa.array(~top), kept.column("score").combine_chunks(), pa.array(rival.astype(float)), kept.column("unique_anchors").combine_chunks()], names)

    sorted_ = chains.select(*own, "chain_rank", (-F.col("score")).alias("_down"))
    return per_group(sorted_, "read_id", ["read_id", "_down", "contig_id", "joint", "chain_rank"], work, FRAGMENT_SCHEMA)
