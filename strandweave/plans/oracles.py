"""DuckDB SQL for whole mappings: chains, selection, refinement and SAM text as recursive queries over lists.

They say the same as the operators from the definitions alone (no shared code), one bucket or
read at a time, and are meant for small tables.
"""

from __future__ import annotations

MASK = (1 << 30) - 1


def seq(text: str = "text") -> str:
    return f"regexp_replace(regexp_replace(translate(lower(coalesce({text}, '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '\\s+', '', 'g'), '[^ACGT]', 'N', 'g')"


def texts(table: str, key: str) -> str:
    return f"SELECT {key} AS id, {seq()} AS seq FROM {table}"


def _shl(x: str, s: int) -> str:
    return f"(({x} & {(1 << (30 - s)) - 1}) * {1 << s})"


def minimizers(n: str, source: str, w: int = 10) -> str:
    """CTEs ``n_s`` (id, seq), ``n_h`` (every k-mer: id, pos, strand, hash) and ``n_m`` (its minimizers), k = 15."""
    code = " + ".join(f"(ascii(substr(t, {i + 1}, 1)) - 48) * {4 ** (14 - i)}" for i in range(15))
    return f"""
    {n}_s AS MATERIALIZED ({source}),
    {n}_k AS (SELECT id, i + 13 AS pos, substr(seq, i, 15) AS km FROM (SELECT id, seq, unnest(range(1, length(seq) - 13)) AS i FROM {n}_s WHERE length(seq) >= 15)),
    {n}_c AS (SELECT id, pos, km, least(km, translate(reverse(km), 'ACGT', 'TGCA')) AS c FROM {n}_k WHERE NOT contains(km, 'N')),
    {n}_x AS (SELECT id, pos, CAST(km <> c AS BIGINT) AS strand, CAST({code} AS BIGINT) AS x FROM (SELECT *, translate(c, 'ACGT', '0123') AS t FROM {n}_c)),
    {n}_1 AS (SELECT id, pos, strand, (({MASK} - x) + {_shl('x', 21)}) & {MASK} AS x FROM {n}_x),
    {n}_2 AS (SELECT id, pos, strand, xor(x, x >> 24) AS x FROM {n}_1),
    {n}_3 AS (SELECT id, pos, strand, (x + {_shl('x', 3)} + {_shl('x', 8)}) & {MASK} AS x FROM {n}_2),
    {n}_4 AS (SELECT id, pos, strand, xor(x, x >> 14) AS x FROM {n}_3),
    {n}_5 AS (SELECT id, pos, strand, (x + {_shl('x', 2)} + {_shl('x', 4)}) & {MASK} AS x FROM {n}_4),
    {n}_h AS (SELECT id, pos, strand, xor(x, x >> 28) AS hash FROM {n}_5),
    {n}_r AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM {n}_h),
    {n}_w AS (SELECT id, min((hash * 4294967296 + (4294967295 - pos)) * 2 + strand) OVER f AS best, count(*) OVER f AS n FROM {n}_r
              WINDOW f AS (PARTITION BY id, run ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)),
    {n}_m AS MATERIALIZED (SELECT DISTINCT id, best >> 33 AS hash, 4294967295 - ((best >> 1) & 4294967295) AS pos, best & 1 AS strand FROM {n}_w WHERE n = {w})"""


def index(n: str) -> str:
    """CTE ``n_i``: the hits of ``n_m`` whose hash has at most 1,000."""
    return f"{n}_i AS MATERIALIZED (SELECT * FROM {n}_m WHERE hash NOT IN (SELECT hash FROM {n}_m GROUP BY hash HAVING count(*) > 1000))"


def anchors(n: str, reads: str, docs: str) -> str:
    """CTE ``n_an``: seeds of ``reads_m`` joined with the hits of ``docs_i``."""
    return f"{n}_an AS MATERIALIZED (SELECT q.id AS read_id, q.pos AS q_pos, i.id AS contig_id, i.pos AS ref_pos, i.hash, xor(q.strand, i.strand) AS joint FROM {reads}_m q JOIN {docs}_i i USING (hash))"


def scores(n: str, least: int = 2) -> str:
    """CTE ``n_dq``: of each bucket of ``least`` anchors or more the anchors in order with best score ``fs``, predecessor ``bs`` (numbers from 1, 0: none) and chain length ``ds``."""
    gap, gap_q = "(rs[i + 1] - rs[j])", "(ss[i + 1] - ss[j])"
    drift = f"abs({gap_q} - {gap})"
    return f"""
    {n}_l AS MATERIALIZED (SELECT read_id, contig_id, joint, list(ref_pos ORDER BY ref_pos, q_pos) AS rs, list(CASE WHEN joint = 1 THEN -q_pos ELSE q_pos END ORDER BY ref_pos, q_pos) AS ss,
                     list(q_pos ORDER BY ref_pos, q_pos) AS qs, list(hash ORDER BY ref_pos, q_pos) AS hs, count(*) AS n FROM {n}_an GROUP BY ALL HAVING count(*) >= {least}),
    {n}_dp AS (SELECT read_id, contig_id, joint, n, CAST(1 AS BIGINT) AS i, [15.0::DOUBLE] AS fs, [CAST(0 AS BIGINT)] AS bs, [CAST(1 AS BIGINT)] AS ds FROM {n}_l
      UNION ALL
      SELECT read_id, contig_id, joint, n, i + 1, list_append(fs, CASE WHEN best.v > 15.0::DOUBLE THEN best.v ELSE 15.0::DOUBLE END),
             list_append(bs, CASE WHEN best.v > 15.0::DOUBLE THEN best.j ELSE 0 END), list_append(ds, CASE WHEN best.v > 15.0::DOUBLE THEN ds[best.j] + 1 ELSE 1 END)
      FROM (SELECT d.*, list_max(list_transform(range(1, i + 1), lambda j: {{'v': CASE
                WHEN {gap} > 0 AND {gap} <= 5000 AND {gap_q} > 0 AND {gap_q} <= 5000 AND {drift} <= 200
                THEN fs[j] + (least({gap_q}, {gap}, 15) - (0.15::DOUBLE * {drift} + CASE WHEN {drift} > 1 THEN 0.5::DOUBLE * log2({drift}) ELSE 0.0::DOUBLE END))
                ELSE -1e300::DOUBLE END, 'j': j}})) AS best FROM {n}_dp d JOIN {n}_l l USING (read_id, contig_id, joint) WHERE i < d.n)),
    {n}_dq AS MATERIALIZED (SELECT d.*, rs, qs, hs FROM {n}_dp d JOIN {n}_l USING (read_id, contig_id, joint) WHERE i = d.n)"""


def chains(n: str) -> str:
    """CTE ``n_ch``: up to ten chains of each bucket, best end first; a walk stops at the first anchor that is taken."""
    return f"""
    {n}_ex AS (SELECT read_id, contig_id, joint, rs, qs, hs, fs, bs, ds, n, CAST(0 AS BIGINT) AS attempt, list_transform(rs, lambda r: FALSE) AS used, CAST(NULL AS BIGINT[]) AS mem, CAST(NULL AS DOUBLE) AS score FROM {n}_dq WHERE n > 1
      UNION ALL
      SELECT read_id, contig_id, joint, rs, qs, hs, fs, bs, ds, n, attempt + 1, list_transform(range(1, n + 1), lambda k: used[k] OR list_contains(new, k)), new, top.f
      FROM (SELECT *, p[(1 + coalesce(list_max(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN used[p[k]] THEN k ELSE 0 END)), 0)):] AS new
            FROM (SELECT *, list_reduce(list_concat([[-top.i]], list_transform(range(1, ds[-top.i]), lambda z: [CAST(0 AS BIGINT)])), lambda way, z: CASE WHEN bs[way[1]] > 0 THEN list_prepend(bs[way[1]], way) ELSE way END) AS p FROM (SELECT *, list_max(list_transform(list_filter(range(1, n + 1), lambda k: NOT used[k]), lambda k: {{'f': fs[k], 'i': -k}})) AS top FROM {n}_ex WHERE attempt < 10) WHERE top.f > 15.0::DOUBLE))),
    {n}_cm AS (SELECT *, row_number() OVER (PARTITION BY read_id, contig_id, joint ORDER BY attempt) - 1 AS chain_rank, list_transform(mem, lambda k: qs[k]) AS cq, list_transform(mem, lambda k: rs[k]) AS cr,
                      len(list_distinct(list_transform(mem, lambda k: hs[k]))) AS unique_anchors FROM {n}_ex WHERE attempt > 0 AND (attempt = 1 OR len(mem) > 1)),
    {n}_ce AS (SELECT *, greatest(0, list_min(cq) - 14) AS q0, greatest(0, list_min(cr) - 14) AS r0 FROM {n}_cm),
    {n}_ch AS MATERIALIZED (SELECT read_id, contig_id, joint, chain_rank, q0 - least(7, q0, r0) AS q_start, list_max(cq) + 8 AS q_end, r0 - least(7, q0, r0) AS ref_start, list_max(cr) + 8 AS ref_end, score,
                      CAST(len(mem) AS BIGINT) AS anchor_count, unique_anchors, cq, cr FROM {n}_ce)"""


def _grown(a: str, b: str) -> str:
    """Bases by which two flanks agree while the last ten comparisons match at 0.7."""
    same = f"len(list_filter(range(greatest(1, i - 9), i + 1), lambda j: substr({a}, j, 1) = substr({b}, j, 1)))"
    return f"coalesce(list_min(list_filter(range(1, length({a}) + 1), lambda i: {same} / least(i, 10)::DOUBLE < 0.7::DOUBLE)) - 1, length({a}))"


def refined(n: str, reads: str, docs: str) -> str:
    """CTE ``n_rc``: the chains with both ends grown by up to 40 bases."""
    before = lambda s, at, size: f"reverse(substr({s}, {at} - {size} + 1, {size}))"
    after = lambda s, at, size: f"substr({s}, {at} + 1, {size})"
    turned = lambda x: f"translate({x}, 'ACGT', 'TGCA')"
    return f"""
    {n}_f1 AS (SELECT c.*, s.seq AS a, regexp_replace(d.seq, '[^ACGT]', 'A', 'g') AS b FROM {n}_ch c JOIN {reads}_s s ON s.id = c.read_id JOIN {docs}_s d ON d.id = c.contig_id),
    {n}_f2 AS (SELECT *, greatest(0, least(40, q_start, CASE WHEN joint = 1 THEN length(b) - ref_end ELSE ref_start END)) AS nl,
                      greatest(0, least(40, length(a) - q_end, CASE WHEN joint = 1 THEN ref_start ELSE length(b) - ref_end END)) AS nr FROM {n}_f1),
    {n}_f3 AS (SELECT *, {before('a', 'q_start', 'nl')} AS la, CASE WHEN joint = 1 THEN {turned(after('b', 'ref_end', 'nl'))} ELSE {before('b', 'ref_start', 'nl')} END AS lb,
                      {after('a', 'q_end', 'nr')} AS ra, CASE WHEN joint = 1 THEN {turned(before('b', 'ref_start', 'nr'))} ELSE {after('b', 'ref_end', 'nr')} END AS rb FROM {n}_f2),
    {n}_f4 AS (SELECT *, {_grown('la', 'lb')} AS l, {_grown('ra', 'rb')} AS e FROM {n}_f3),
    {n}_rc AS MATERIALIZED (SELECT read_id, contig_id, joint, chain_rank, q_start - l AS q_start, q_end + e AS q_end, CASE WHEN joint = 1 THEN ref_start - e ELSE ref_start - l END AS ref_start,
                      CASE WHEN joint = 1 THEN ref_end + l ELSE ref_end + e END AS ref_end, score, anchor_count, unique_anchors FROM {n}_f4)"""


def fragments(n: str, source: str, secondary: int = 0) -> str:
    """CTE ``n_pl``: the greedy choice from the chains in ``source``, best score first; ``acc`` are the chains taken, ``home`` the fragment each chain belongs to (0: none)."""
    common = "(least(cs[a].q_end, cs[i + 1].q_end) - greatest(cs[a].q_start, cs[i + 1].q_start))"
    return f"""
    {n}_rl AS (SELECT read_id, list({{'contig_id': contig_id, 'joint': joint, 'q_start': q_start, 'q_end': q_end, 'ref_start': ref_start, 'ref_end': ref_end, 'score': score, 'anchor_count': anchor_count, 'unique_anchors': unique_anchors}}
                      ORDER BY score DESC, contig_id, joint, chain_rank) AS cs, count(*) AS n FROM {source} GROUP BY read_id),
    {n}_gr AS (SELECT *, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS acc, CAST([] AS BIGINT[]) AS home FROM {n}_rl
      UNION ALL
      SELECT read_id, cs, n, i + 1, CASE WHEN own THEN list_append(acc, i + 1) ELSE acc END, list_append(home, CASE WHEN own THEN i + 1 WHEN alt THEN host ELSE 0 END)
      FROM (SELECT *, host IS NULL AND c.ref_end - c.ref_start >= 40 AND c.anchor_count >= 3 AND c.score >= 0.28::DOUBLE * cs[1].score AS own,
                   coalesce(greatest(0, least(cs[host].q_end, c.q_end) - greatest(cs[host].q_start, c.q_start)) / greatest(1, c.q_end - c.q_start)::DOUBLE >= 0.8::DOUBLE AND c.anchor_count >= 3, FALSE) AS alt
            FROM (SELECT *, cs[i + 1] AS c, list_filter(acc, lambda a: {common} > 20)[1] AS host FROM {n}_gr WHERE i < n))),
    {n}_un AS (SELECT read_id, acc[1] AS best, unnest(cs) AS c, unnest(home) AS home, unnest(range(1, n + 1)) AS k FROM {n}_gr WHERE i = n),
    {n}_ld AS (SELECT *, row_number() OVER l - 1 AS alt_rank, coalesce(lead(c.score) OVER l, 0.0::DOUBLE) AS f2, first_value(c.q_start) OVER l AS hq FROM {n}_un WHERE home > 0 WINDOW l AS (PARTITION BY read_id, home ORDER BY k)),
    {n}_pl AS MATERIALIZED (SELECT read_id, c.contig_id AS contig_id, c.joint AS joint, c.q_start AS q_start, c.q_end AS q_end, c.ref_start AS ref_start, c.ref_end AS ref_end, c.score AS score, c.anchor_count AS anchor_count,
                      CAST(c.unique_anchors AS BIGINT) AS unique_anchors, dense_rank() OVER (PARTITION BY read_id ORDER BY hq, home) - 1 AS fragment_index, alt_rank, home = best AND alt_rank = 0 AS is_primary,
                      home <> best AND alt_rank = 0 AS is_supplementary, alt_rank > 0 AS is_secondary, c.score AS f1, f2, CAST(c.unique_anchors AS BIGINT) AS m FROM {n}_ld WHERE alt_rank <= {secondary})"""


def mapq(f1: str = "f1", f2: str = "f2", m: str = "m") -> str:
    raw = f"40.0::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN {f2} > 0 THEN {f2} / {f1} ELSE 0.0::DOUBLE END) * least(1.0::DOUBLE, {m} / 10.0::DOUBLE) * ln({f1})"
    return f"CAST(least(60, floor(greatest({raw}, 0.0::DOUBLE) + 0.5::DOUBLE)) AS BIGINT)"


def mapping(n: str, reads: str, docs: str, refine: bool = False, secondary: int = 0) -> str:
    """All CTEs from ``reads_m`` and ``docs_i`` to ``n_pl``."""
    steps = [anchors(n, reads, docs), scores(n), chains(n)]
    if refine:
        steps.append(refined(n, reads, docs))
    return ",\n".join([*steps, fragments(n, f"{n}_rc" if refine else f"{n}_ch", secondary)])


def sam(n: str, reads: str) -> str:
    """CTE ``n_sam``: the SAM records of ``n_pl`` and of the reads without one; reads are benchmark items, contigs documents."""
    clip = "CASE WHEN is_secondary THEN 'H' ELSE 'S' END"
    turned = "translate(reverse(seq), 'ACGT', 'TGCA')"
    return f"""
    {n}_s1 AS (SELECT p.*, s.seq, 'doc' || contig_id AS rname, {mapq()} AS mapq,
                      CASE WHEN ref_end - ref_start <= 0 THEN '*' ELSE CASE WHEN q_start > 0 THEN q_start || {clip} ELSE '' END || (ref_end - ref_start) || 'M' ||
                           CASE WHEN length(s.seq) - q_end > 0 THEN (length(s.seq) - q_end) || {clip} ELSE '' END END AS cigar FROM {n}_pl p JOIN {reads}_s s ON s.id = read_id),
    {n}_s2 AS (SELECT read_id, string_agg(rname || ',' || (ref_start + 1) || CASE WHEN joint = 1 THEN ',-,' ELSE ',+,' END || cigar || ',' || mapq || ',0;', '' ORDER BY fragment_index) AS sa FROM {n}_s1 WHERE NOT is_secondary GROUP BY read_id HAVING count(*) > 1),
    {n}_sam AS MATERIALIZED (SELECT read_id, fragment_index, alt_rank, 'item' || read_id AS name, joint * 16 + is_supplementary::BIGINT * 2048 + is_secondary::BIGINT * 256 AS flag, rname, ref_start + 1 AS pos, mapq, cigar,
                       CASE WHEN NOT is_primary THEN '*' WHEN joint = 1 THEN {turned} ELSE seq END AS seq, CASE WHEN is_primary THEN repeat('I', length(seq)) ELSE '*' END AS qual,
                       CASE WHEN sa IS NOT NULL AND NOT is_secondary THEN '\tSA:Z:' || sa ELSE '' END || '\tAS:i:' || CAST(floor(score + 0.5::DOUBLE) AS BIGINT) || '\tnm:i:' || unique_anchors AS tags, q_start, q_end, ref_end - ref_start AS span
                FROM {n}_s1 LEFT JOIN {n}_s2 USING (read_id)
      UNION ALL SELECT id, 0, 0, 'item' || id, 4, '*', 0, 0, '*', CASE WHEN seq = '' THEN '*' ELSE seq END, CASE WHEN seq = '' THEN '*' ELSE repeat('I', length(seq)) END, '', 0, 0, 0 FROM {reads}_s WHERE id NOT IN (SELECT read_id FROM {n}_pl))"""


LINE = r"name || '\t' || flag || '\t' || rname || '\t' || pos || '\t' || mapq || '\t' || cigar || '\t*\t0\t0\t' || seq || '\t' || qual || tags".replace(r"\t", "\t")


def cut(docs: str, size: int = 300) -> str:
    """Reads cut from every document: (id, start, seq), odd ones reverse-complemented."""
    return f"""SELECT id, start, CASE WHEN id % 2 = 1 THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END AS seq
               FROM (SELECT id, start, substr(seq, start + 1, {size}) AS s FROM (SELECT id, seq, (id * 37) % greatest(1, length(seq) - {size}) AS start FROM {docs}_s))"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


D, B = minimizers("d", texts("documents", "doc_id")), minimizers("b", texts("benchmark", "item_id"))
BASE = (D, index("d"), B)
FRAGMENT = f"read_id, contig_id, joint, q_start, q_end, ref_start, ref_end, round(score, 6) AS score, anchor_count, unique_anchors, fragment_index, alt_rank, is_primary, is_supplementary, is_secondary, round(f1, 6) AS f1, round(f2, 6) AS f2, m, {mapq()} AS mapq"
STRUCT = "{'contig': rname, 'reverse': (flag & 16) > 0, 'pos': pos - 1, 'mapq': mapq, 'q': q, 'cigar': cigar}"


def parsed(n: str) -> str:
    """Columns of a parsed SAM table, from ``n_sam``."""
    return f"SELECT read_id, name, flag, rname, pos - 1 AS pos0, mapq, cigar, CASE WHEN cigar = '*' THEN 0 ELSE q_start END AS q_start, CASE WHEN cigar = '*' THEN 0 ELSE CASE WHEN (flag & 256) > 0 THEN 0 ELSE q_start END + span END AS q_end, CASE WHEN cigar = '*' THEN 0 ELSE span END AS ref_span FROM {n}_sam"


DIFF = f"""
    ps AS ({parsed('m')}), gs AS ({parsed('g')}),
    po AS (SELECT name, list({{'contig': rname, 'reverse': (flag & 16) > 0, 'pos': pos0, 'mapq': mapq}} ORDER BY q_start, pos0, rname, (flag & 16), mapq, cigar) AS xs FROM ps WHERE rname <> '*' GROUP BY name),
    go AS (SELECT name, list({{'contig': rname, 'reverse': (flag & 16) > 0, 'pos': pos0, 'mapq': mapq}} ORDER BY q_start, pos0, rname, (flag & 16), mapq, cigar) AS ys FROM gs WHERE rname <> '*' GROUP BY name),
    pr AS (SELECT name, xs, ys, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS y FROM po JOIN go USING (name)
      UNION ALL
      SELECT name, xs, ys, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, -best.k) END, -best.k
      FROM (SELECT *, list_max(list_transform(list_filter(range(1, len(ys) + 1), lambda k: NOT list_contains(used, k) AND ys[k].contig = xs[i + 1].contig AND ys[k].reverse = xs[i + 1].reverse), lambda k: {{'d': -abs(ys[k].pos - xs[i + 1].pos), 'k': -k}})) AS best FROM pr WHERE i < len(xs))),
    pp AS (SELECT abs(ys[y].pos - xs[i].pos) AS distance, xs[i].mapq AS a, ys[y].mapq AS b FROM pr WHERE y IS NOT NULL),
    pm AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM pp WHERE distance <= 10)"""

JACCARD = """
    x AS (SELECT DISTINCT name FROM {a} WHERE rname <> '*'), y AS (SELECT DISTINCT name FROM {b} WHERE rname <> '*'),
    j AS (SELECT (SELECT count(*) FROM x) AS n_ours, (SELECT count(*) FROM y) AS n_golden, (SELECT count(*) FROM x JOIN y USING (name)) AS n_both, (SELECT count(*) FROM (SELECT name FROM x UNION SELECT name FROM y)) AS n_any)"""


MAPPED = {
    "chains": with_(*BASE, anchors("m", "b", "d"), scores("m"), chains("m"))
    + " SELECT read_id, contig_id, joint, chain_rank, q_start, q_end, ref_start, ref_end, round(score, 6) AS score, anchor_count, CAST(unique_anchors AS BIGINT) AS unique_anchors, list_aggregate(list_transform(range(1, len(cq) + 1), lambda k: cq[k] || ':' || cr[k]), 'string_agg', ',') AS anchors FROM m_ch",
    "fragments": with_(*BASE, mapping("m", "b", "d")) + f" SELECT {FRAGMENT} FROM m_pl",
    "secondary_fragments": with_(*BASE, mapping("m", "b", "d", secondary=5)) + f" SELECT {FRAGMENT} FROM m_pl",
    "refined_fragments": with_(*BASE, mapping("m", "b", "d", refine=True)) + f" SELECT {FRAGMENT} FROM m_pl",
    "sam_body": with_(*BASE, mapping("m", "b", "d"), sam("m", "b")) + f" SELECT read_id, fragment_index, alt_rank, {LINE} AS value FROM m_sam",
    "sam_unplaced": with_(*BASE, mapping("m", "b", "d"), sam("m", "b")) + f" SELECT read_id, {LINE} AS value FROM m_sam WHERE flag = 4",
    "sam_parsed": with_(*BASE, mapping("m", "b", "d"), sam("m", "b"))
    + f" SELECT name, flag, rname AS ref_name, pos0, mapq, cigar, (flag & 16) > 0 AS reverse, (flag & 256) > 0 AS secondary, (flag & 2048) > 0 AS supplementary, (flag & 4) > 0 OR rname = '*' AS unmapped, q_start, q_end, ref_span FROM ({parsed('m')})",
    "sam_counters": with_(*BASE, mapping("m", "b", "d", secondary=5), sam("m", "b"))
    + " SELECT count(DISTINCT name) FILTER (flag & 4 = 0) AS mapped, count(DISTINCT name) FILTER (flag & 4 > 0) AS unmapped, count(*) FILTER (flag & 2048 > 0) AS supplementary, count(*) FILTER (flag & 256 > 0) AS secondary, count(*) AS records FROM m_sam",
    "sam_diff": with_(*BASE, mapping("m", "b", "d"), sam("m", "b"), mapping("g", "b", "d", refine=True), sam("g", "b"), DIFF, JACCARD.format(a="ps", b="gs"))
    + """ SELECT (SELECT count(*) FROM pp) AS compared, (SELECT count(*) FROM pp WHERE distance <= 10) AS matched, coalesce((SELECT sqrt(avg((a - b) * (a - b)::DOUBLE)) FROM pm), 0.0::DOUBLE) AS mapq_rmse,
          coalesce((SELECT CASE WHEN isnan(corr(ra, rb)) THEN 0.0::DOUBLE ELSE round(corr(ra, rb), 6) END FROM pm), 0.0::DOUBLE) AS mapq_spearman, n_ours, n_golden, n_both, n_any,
          n_both / n_any::DOUBLE AS jaccard, coalesce((SELECT count(*) FILTER (distance <= 10) / nullif(count(*), 0)::DOUBLE FROM pp), 0.0::DOUBLE) AS match_rate,
          (SELECT count(*) FROM ps WHERE rname <> '*') AS records_ours, (SELECT count(*) FROM gs WHERE rname <> '*') AS records_golden FROM j""",
    "mapped_jaccard": with_(*BASE, minimizers("d2", texts("documents", "doc_id"), 15), index("d2"), minimizers("b2", texts("benchmark", "item_id"), 15), mapping("m", "b", "d"), sam("m", "b"), mapping("g", "b2", "d2"), sam("g", "b2"), JACCARD.format(a="m_sam", b="g_sam"))
    + " SELECT n_ours, n_golden, n_both, n_any, n_both / n_any::DOUBLE AS jaccard FROM j",
    "mapping_stats": with_(*BASE, mapping("m", "b", "d"))
    + """ SELECT (SELECT count(*) FROM b_s) AS reads, (SELECT count(DISTINCT read_id) FROM m_pl) AS mapped, (SELECT count(*) FROM m_pl WHERE NOT is_secondary) AS fragments, (SELECT count(*) FROM m_an) AS anchors,
          (SELECT count(DISTINCT hash & 4095) FROM b_m) AS shards_touched, (SELECT count(*) FROM b_s) - (SELECT count(DISTINCT read_id) FROM m_pl) AS unmapped""",
    "truth_accuracy": with_(D, index("d"), f"ct AS MATERIALIZED ({cut('d')})", minimizers("c", "SELECT id, seq FROM ct"), mapping("m", "c", "d"))
    + """ SELECT count(*) AS n_reads, count(contig_id) AS n_placed, count(*) FILTER (good) AS n_right, count(*) FILTER (good AND off <= 10) AS within_10, count(*) FILTER (good AND off <= 50) AS within_50, count(*) FILTER (good AND off <= 200) AS within_200
          FROM (SELECT contig_id, contig_id = id AND joint = id % 2 AS good, abs(ref_start - start) AS off FROM ct LEFT JOIN m_pl ON read_id = id AND is_primary)""",
    "contacts": with_(D, index("d"), f"ct AS MATERIALIZED ({cut('d')})", minimizers("c", "SELECT a.id, a.seq || b.seq AS seq FROM ct a JOIN ct b ON b.id = a.id + 1"), mapping("m", "c", "d"),
        f"mo AS (SELECT read_id, fragment_index AS f, contig_id AS c, ref_start AS p FROM m_pl WHERE NOT is_secondary AND {mapq()} >= 1)",
        "pa AS (SELECT a.read_id, least({'c': a.c, 'p': a.p}, {'c': b.c, 'p': b.p}) AS lo, greatest({'c': a.c, 'p': a.p}, {'c': b.c, 'p': b.p}) AS hi FROM mo a JOIN mo b ON a.read_id = b.read_id AND a.f < b.f WHERE a.c <> b.c OR abs(a.p - b.p) >= 1000)",
        "du AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY read_id) > 1 AS d, lo.c = hi.c AS cis FROM pa)")
    + " SELECT count(*) AS raw, count(*) FILTER (d) AS duplicates, count(*) FILTER (NOT d AND cis) AS cis, count(*) FILTER (NOT d AND NOT cis) AS trans, coalesce(count(*) FILTER (NOT d AND cis) / nullif(count(*) FILTER (NOT d), 0)::DOUBLE, 0.0::DOUBLE) AS cis_fraction FROM du",
}
