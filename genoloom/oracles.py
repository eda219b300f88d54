"""Plain SQL that every registered query must agree with.

Written for the retail tables directly and, where it can be, by another route than
the Spark side: sequences base by base, coordinates by one window per sample, graph
rows from the closed form of the ten-base site spacing's breakpoints.
"""

from __future__ import annotations

_BASE: dict[str, str] = {
    "ref_base": """SELECT p_partkey + 1 AS pos,
        substr('ACGT', CAST(p_size % 4 AS INT) + 1, 1) AS base FROM part""",
    "vcall": """SELECT l_partkey + 1 AS pos,
        CASE l_partkey % 30 WHEN 3 THEN 'SUB' WHEN 13 THEN 'INS' ELSE 'DEL' END AS kind,
        l_suppkey AS sample_id,
        max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS phase,
        max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS gt1,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS gt2
        FROM lineitem WHERE l_partkey % 10 = 3 GROUP BY 1, 2, 3""",
    "site": """SELECT d.pos, d.kind,
        CASE d.kind WHEN 'SUB' THEN b.base WHEN 'INS' THEN '' ELSE concat(b.base, b2.base) END AS ref,
        CASE d.kind WHEN 'SUB' THEN translate(b.base, 'ACGT', 'CGTA') WHEN 'INS' THEN 'AC' ELSE '' END AS alt,
        CASE d.kind WHEN 'SUB' THEN 0 WHEN 'INS' THEN 2 ELSE -2 END AS delta,
        d.pos + CASE d.kind WHEN 'INS' THEN 1 ELSE 0 END AS lo,
        d.pos + CASE d.kind WHEN 'DEL' THEN 1 ELSE 0 END AS hi
        FROM (SELECT DISTINCT pos, kind FROM vcall) d
        JOIN ref_base b ON b.pos = d.pos JOIN ref_base b2 ON b2.pos = d.pos + 1""",
    "len": "SELECT count(*) AS length FROM part",
    "named": """SELECT v.*, s.s_name AS name,
        concat(CASE WHEN gt1 = 1 THEN '1' ELSE '0' END, CASE WHEN phase = 1 THEN '|' ELSE '/' END,
               CASE WHEN gt2 = 1 THEN '1' ELSE '0' END) AS phasing
        FROM vcall v JOIN supplier s ON s.s_suppkey = v.sample_id""",
    "req": """SELECT s_suppkey AS region_id, s_suppkey AS sample_id,
        (s_suppkey * 97) % greatest(length - 300, 1) + 1 AS x,
        (s_suppkey * 97) % greatest(length - 300, 1) + 301 AS y FROM supplier, len""",
    "probe": "SELECT event_id AS query_id, (event_id * 7919) % length + 1 AS spot FROM events, len",
    "coord": """SELECT v.sample_id, s.*, CAST(coalesce(sum(s.delta) OVER (PARTITION BY v.sample_id
        ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift
        FROM vcall v JOIN site s ON s.pos = v.pos""",
    # What each sample reads at each reference base: inserted bases first.
    "reading": """SELECT s.sample_id, b.pos, concat(
          CASE WHEN i.pos IS NOT NULL THEN i.alt ELSE '' END,
          CASE WHEN c.kind = 'SUB' THEN c.alt WHEN c.kind = 'DEL' THEN '' ELSE b.base END) AS out
        FROM (SELECT DISTINCT s_suppkey AS sample_id FROM supplier) s CROSS JOIN ref_base b
        LEFT JOIN coord i ON i.sample_id = s.sample_id AND i.kind = 'INS' AND i.pos + 1 = b.pos
        LEFT JOIN coord c ON c.sample_id = s.sample_id AND c.kind <> 'INS' AND b.pos BETWEEN c.lo AND c.hi""",
    "bp": """SELECT DISTINCT b AS ref_start FROM (SELECT lo AS b FROM site UNION ALL
        SELECT hi + 1 FROM site UNION ALL SELECT 1), len WHERE b BETWEEN 1 AND length""",
    "rseg": """SELECT 2 * ref_start AS seg_id, ref_start,
        coalesce(lead(ref_start) OVER (ORDER BY ref_start) - 1, length) AS ref_end,
        lag(ref_start) OVER (ORDER BY ref_start) AS prev_start,
        lead(ref_start) OVER (ORDER BY ref_start) AS next_start,
        row_number() OVER (ORDER BY ref_start) AS rank FROM bp, len""",
    "segm": """SELECT seg_id, 'REF' AS kind, ref_start, ref_end, ref_end - ref_start + 1 AS length,
        '' AS seq, CAST(NULL AS BIGINT) AS site_id FROM rseg UNION ALL
        SELECT 2 * pos + 1, kind, lo, hi, length(alt), alt, pos FROM site WHERE alt <> ''""",
    "sedge": """SELECT s.*, r.seg_id AS from_id, CASE WHEN alt <> '' THEN 2 * s.pos + 1 END AS via,
        CASE WHEN s.hi < length THEN 2 * (s.hi + 1) END AS leaves
        FROM site s LEFT JOIN rseg r ON r.ref_end = s.lo - 1, len""",
    "edg": """SELECT seg_id AS src, 2 * next_start AS dst FROM rseg WHERE next_start IS NOT NULL
        UNION ALL SELECT from_id, coalesce(via, leaves) FROM sedge
          WHERE from_id IS NOT NULL AND coalesce(via, leaves) IS NOT NULL
        UNION ALL SELECT via, leaves FROM sedge WHERE via IS NOT NULL AND leaves IS NOT NULL""",
    "mark": """SELECT CASE WHEN alt <> '' THEN 2 * pos + 1 ELSE 2 * (hi + 1) END AS seg_id, sample_id,
        pos AS site_id, lo + shift AS idx FROM coord, len WHERE alt <> '' OR hi < length""",
    "roots": """SELECT q.region_id AS root, 2 * max(b.ref_start) AS seg_id FROM req q
        JOIN bp b ON b.ref_start <= q.x GROUP BY 1""",
    "klass": """SELECT site_id, min(site_id) OVER (PARTITION BY members) AS class_id, members FROM (
        SELECT pos AS site_id, list(sample_id ORDER BY sample_id) AS members FROM vcall GROUP BY 1)""",
    "dense": """SELECT CASE WHEN p_partkey % 4 < 2 THEN 'a' ELSE 'b' END AS chrom, p_partkey + 1 AS pos,
        CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE -4 * p_size END AS delta,
        p_partkey + 1 + CASE p_partkey % 6 WHEN 2 THEN 1 ELSE 0 END AS lo,
        p_partkey + 1 + CASE p_partkey % 6 WHEN 4 THEN 4 * p_size - 1 ELSE 0 END AS hi
        FROM part WHERE p_partkey % 2 = 0""",
    "dcall": """SELECT DISTINCT CASE WHEN l_partkey % 4 < 2 THEN 'a' ELSE 'b' END AS chrom, l_partkey + 1 AS pos,
        l_suppkey % 7 + 1 AS sample_id FROM lineitem WHERE l_partkey % 2 = 0""",
    "queue": """SELECT d.*, c.sample_id, row_number() OVER (PARTITION BY c.chrom, c.sample_id
        ORDER BY d.lo, d.pos) AS r FROM dense d JOIN dcall c ON c.chrom = d.chrom AND c.pos = d.pos""",
    "wide": """SELECT p_partkey + 1 AS pos, k AS col, CASE WHEN p_size % 2 = 1 AND contains(g, '2') THEN '0/1' ELSE g END AS gt,
        p_size % 2 = 0 AS two FROM (SELECT *, (['0|0', '0|1', '1|1', '1|2', './.', '2|0'])[(p_partkey * 7 + 3 * k) % 6 + 1] AS g
        FROM (SELECT *, unnest(range(7)) AS k FROM part WHERE p_partkey % 10 = 3))""",
    "cnt": """SELECT l_linestatus, l_partkey AS key, l_suppkey AS value, count(*) AS count
        FROM lineitem GROUP BY 1, 2, 3""",
    "raw": """SELECT s.pos AS site_id, CASE s.kind WHEN 'DEL' THEN s.pos - 1 ELSE s.pos END AS pos,
        concat(CASE WHEN s.kind = 'SUB' THEN '' ELSE b.base END, s.ref) AS ref,
        concat(CASE WHEN s.kind = 'SUB' THEN '' ELSE b.base END, s.alt) AS alt
        FROM site s JOIN ref_base b ON b.pos = s.pos - CASE s.kind WHEN 'DEL' THEN 1 ELSE 0 END""",
    "made": """SELECT p_partkey, substr(p_type, 1, 1 + p_size % 4) AS ref,
        CASE WHEN p_partkey % 4 = 0 THEN upper(substr(p_name, 1, CAST(1 + p_partkey % 3 AS INT)))
             ELSE substr(p_type, 1, CAST(1 + p_partkey % 5 AS INT)) END AS alt FROM part""",
    "gtx": """SELECT l_orderkey, l_linenumber, l_suppkey % 2 + 1 AS ordinal,
        CASE WHEN l_linenumber = 7 THEN CAST(l_orderkey % 3 AS VARCHAR)
             WHEN l_linenumber = 6 THEN concat('.', m, l_partkey % 4)
             WHEN l_linenumber = 5 THEN concat(l_orderkey % 3, m, '12')
             ELSE concat(l_orderkey % 3, m, l_partkey % 4) END AS gt
        FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN '|' ELSE '/' END AS m FROM lineitem)""",
    "gtp": """SELECT *, list_transform(string_split(replace(gt, '|', '/'), '/'),
        lambda p: try_cast(p AS INT)) AS p FROM gtx""",
}

_NEEDS: dict[str, list[str]] = {
    "ref_base": [], "vcall": [], "site": ["vcall", "ref_base"], "len": [], "named": ["vcall"],
    "req": ["len"], "probe": ["len"], "coord": ["site"], "reading": ["coord"], "bp": ["site", "len"],
    "rseg": ["bp"], "segm": ["rseg"], "sedge": ["rseg"], "edg": ["sedge"], "mark": ["coord", "len"],
    "roots": ["req", "bp"], "klass": ["vcall"], "cnt": [], "raw": ["site"], "dense": [], "dcall": [], "queue": ["dense", "dcall"], "wide": [], "made": [], "gtx": [],
    "gtp": ["gtx"],
}


def _with(names: str, body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({_BASE[n]})" for n in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    joiner = ",\n" if recursive else "\n"
    return f"{head}{ctes}{joiner}{body}" if ctes else body


def _reach(radius: int) -> str:
    """Hop distances by repeated expansion, shortest kept."""
    return f"""walk(root, seg_id, hops) AS (
        SELECT root, seg_id, 0 FROM roots UNION
        SELECT w.root, e.dst, w.hops + 1 FROM walk w JOIN edg e ON e.src = w.seg_id WHERE w.hops < {radius}),
    found AS (SELECT root, seg_id, min(hops) AS hops FROM walk GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "q1_closest_variant": _with("probe site", """SELECT query_id, spot AS "at", pos, kind, ref, alt,
            abs(spot - pos) AS distance FROM (SELECT p.*, s.*, rank() OVER (PARTITION BY query_id
            ORDER BY abs(p.spot - s.pos), s.pos) AS r FROM probe p CROSS JOIN site s) WHERE r = 1"""),
        "q2_sample_seq_ref": _with("req reading", """SELECT q.region_id, q.sample_id,
            string_agg(r.out, '' ORDER BY r.pos) AS sequence FROM req q JOIN reading r
            ON r.sample_id = q.sample_id AND r.pos >= q.x AND r.pos < q.y GROUP BY 1, 2"""),
        "q3_sample_seq_sample": _with("req reading", """SELECT q.region_id, q.sample_id,
            substr(w.whole, q.x, q.y - q.x) AS sequence FROM req q JOIN (
              SELECT sample_id, string_agg(out, '' ORDER BY pos) AS whole FROM reading GROUP BY 1) w
            ON w.sample_id = q.sample_id"""),
        "q4_sample_var_ref": _with("req site named", """SELECT q.region_id, q.sample_id, s.pos, s.kind,
            s.ref, s.alt, n.name, n.phasing FROM req q JOIN vcall v ON v.sample_id = q.sample_id
            AND v.pos >= q.x AND v.pos < q.y JOIN site s ON s.pos = v.pos JOIN named n ON n.pos = s.pos"""),
        "q5_sample_var_sample": _with("req coord named", """SELECT q.region_id, q.sample_id, c.pos,
            c.pos + c.shift AS sample_pos, c.kind, c.ref, c.alt, n.name, n.phasing FROM req q
            JOIN coord c ON c.sample_id = q.sample_id AND c.pos + c.shift >= q.x AND c.pos + c.shift < q.y
            JOIN named n ON n.pos = c.pos"""),
        "q6_var_in_ref": _with("req site named", """SELECT q.region_id, s.pos, s.kind, s.ref, s.alt,
            n.sample_id // 65536 AS part, count(*) AS n_samples,
            string_agg(concat(n.name, '(', n.phasing, ')'), ' ' ORDER BY n.sample_id) AS samples
            FROM req q JOIN site s ON s.pos >= q.x AND s.pos < q.y JOIN named n ON n.pos = s.pos
            GROUP BY 1, 2, 3, 4, 5, 6"""),
        "q7_samples_with_variant": _with("site named", """SELECT s.pos AS query_id, s.pos, s.ref, s.alt,
            n.name, n.phasing FROM site s JOIN named n ON n.pos = s.pos"""),
        "bgzip_read": _with("raw", "SELECT 'x' AS chrom, pos, ref, alt FROM raw"),
        "bgzip_region_read": _with("raw len", """SELECT DISTINCT 'x' AS chrom, pos, ref, alt FROM raw, len,
            (SELECT unnest(range(10)) AS k) WHERE pos < k * length // 10 + 301 AND pos + length(ref) > k * length // 10 + 1"""),
        "range_join_variants": _with("req site", """SELECT q.region_id, s.pos, s.kind, s.ref, s.alt
            FROM req q JOIN site s ON s.pos >= q.x AND s.pos < q.y"""),
        "variant_counts": _with("req site", """SELECT q.region_id, count(s.pos) AS n_variants
            FROM (SELECT region_id, x, y FROM req UNION ALL SELECT 0, length + 1, length + 9 FROM len) q
            LEFT JOIN site s ON s.pos >= q.x AND s.pos < q.y GROUP BY 1"""),
        "interval_overlap": _with("req rseg", """SELECT q.region_id, r.seg_id, r.ref_start, r.ref_end
            FROM req q JOIN rseg r ON r.ref_start < q.y AND r.ref_end >= q.x"""),
        "interval_contained": _with("req rseg", """SELECT q.region_id, r.seg_id, r.ref_start, r.ref_end
            FROM req q JOIN rseg r ON r.ref_start >= q.x AND r.ref_end < q.y"""),
        "asof_position_index": _with("probe rseg", """SELECT p.query_id, p.spot AS "at", r.ref_start, r.seg_id, r.rank
            FROM probe p JOIN rseg r ON p.spot BETWEEN r.ref_start AND r.ref_end"""),
        "prev_ref_node": _with("rseg", """SELECT rank, ref_start,
            coalesce(prev_start, ref_start) AS prev_start FROM rseg"""),
        "next_ref_node": _with("rseg", """SELECT rank, ref_start, next_start FROM rseg
            WHERE next_start IS NOT NULL"""),
        "nth_ref_node": _with("rseg", """SELECT r.rank, a.asked, r.ref_start FROM rseg r JOIN (
            SELECT event_id % (SELECT count(*) FROM bp) + 1 AS rank, count(*) AS asked FROM events GROUP BY 1) a
            ON a.rank = r.rank"""),
        "window_is_empty": _with("probe bp", """SELECT query_id, spot AS x, spot + query_id % 5 AS y,
            CASE WHEN n.b IS NULL OR n.b - 1 > spot + query_id % 5 THEN 1 ELSE 0 END AS is_empty
            FROM probe p LEFT JOIN (SELECT p2.spot AS a, min(ref_start) AS b FROM (
              SELECT DISTINCT spot FROM probe) p2 JOIN bp ON ref_start > p2.spot GROUP BY 1) n ON n.a = p.spot"""),
        "next_variant": _with("probe site", """SELECT p.query_id, p.spot AS "at", s.pos, s.kind, s.ref, s.alt
            FROM probe p JOIN (SELECT a.spot, min(s.pos) AS pos FROM (SELECT DISTINCT spot FROM probe) a
              JOIN site s ON s.pos >= a.spot GROUP BY 1) n ON n.spot = p.spot JOIN site s ON s.pos = n.pos"""),
        "prev_sample_variant": _with("req coord", """SELECT region_id, sample_id, spot AS "at", pos,
            sample_pos FROM (SELECT q.region_id, q.sample_id, q.y AS spot, c.pos,
              c.pos + c.shift AS sample_pos, row_number() OVER (PARTITION BY q.region_id
              ORDER BY c.pos DESC) AS r FROM req q JOIN coord c ON c.sample_id = q.sample_id
              AND c.pos < q.y) WHERE r = 1"""),
        "coord_running_delta": _with("coord", """SELECT sample_id, pos, kind, shift,
            pos + shift AS sample_pos FROM coord"""),
        "sample_path_length": _with("coord len", """SELECT s.s_suppkey AS sample_id, s.s_name AS name,
            coalesce(n, 0) AS n_variants, CAST(length + coalesce(d, 0) AS BIGINT) AS path_length
            FROM supplier s LEFT JOIN (SELECT sample_id, count(*) AS n, sum(delta) AS d FROM coord GROUP BY 1) c
            ON s.s_suppkey = c.sample_id, len"""),
        "subsequence": _with("req ref_base", """SELECT q.region_id, string_agg(b.base, '' ORDER BY b.pos) AS bases
            FROM req q JOIN ref_base b ON b.pos >= q.x AND b.pos < q.y GROUP BY 1"""),
        "sample_class_dictionary": _with("klass", "SELECT site_id, class_id FROM klass"),
        "class_popcount": _with("klass", """SELECT class_id, CAST(any_value(len(members)) AS BIGINT) AS n_samples
            FROM klass GROUP BY 1"""),
        "class_nth_sample": _with("klass", """SELECT class_id, class_id % len(members) + 1 AS n,
            members[class_id % len(members) + 1] AS sample_id FROM klass WHERE site_id = class_id"""),
        "sample_path": _with("reading", """SELECT sample_id, (pos - 1) // 64 AS cell,
            string_agg(out, '' ORDER BY pos) AS text FROM reading GROUP BY 1, 2"""),
        "stored_round_trip": _with("site", """SELECT s.pos, s.kind, s.ref, s.alt, s.delta, v.sample_id, v.phase,
            v.gt1, v.gt2 FROM site s JOIN vcall v ON v.pos = s.pos"""),
        "stored_graph": _with("segm edg coord", """SELECT 'segment' AS relation, seg_id AS a, ref_start AS b, ref_end AS c FROM segm
            UNION ALL SELECT 'edge', src, dst, 0 FROM edg UNION ALL SELECT 'coord', sample_id, pos, pos + shift FROM coord"""),
        "merged_files": _with("site named", """SELECT s.pos, s.kind, s.ref, s.alt, v.name, v.phasing
            FROM site s JOIN named v ON v.pos = s.pos"""),
        "path_overlaps": _with("queue", """walk(chrom, sample_id, r, reach, taken) AS (
            SELECT chrom, sample_id, r, hi, 1 FROM queue WHERE r = 1 UNION ALL
            SELECT q.chrom, q.sample_id, q.r, CASE WHEN q.lo > w.reach THEN q.hi ELSE w.reach END,
              CASE WHEN q.lo > w.reach THEN 1 ELSE 0 END
            FROM walk w JOIN queue q ON q.chrom = w.chrom AND q.sample_id = w.sample_id AND q.r = w.r + 1),
            placed AS (SELECT q.chrom, q.sample_id, q.pos, w.taken AS on_path, CAST(coalesce(sum(q.delta * w.taken) OVER (
              PARTITION BY q.chrom, q.sample_id ORDER BY q.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift
              FROM queue q JOIN walk w ON w.chrom = q.chrom AND w.sample_id = q.sample_id AND w.r = q.r)
            SELECT *, pos + shift AS sample_pos FROM placed""", True),
        "sample_class_shared": _with("dcall", """SELECT chrom, class_id, count(*) AS n_sites, max(site_id) AS last_site FROM (
            SELECT chrom, site_id, min(site_id) OVER (PARTITION BY chrom, members) AS class_id FROM (
              SELECT chrom, pos AS site_id, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) AS members
              FROM dcall GROUP BY 1, 2)) GROUP BY 1, 2"""),
        "vcf_wide_parse": _with("wide", """SELECT pos, alt, col, CAST(NULL AS VARCHAR) AS name, phase, gt1, gt2 FROM (
              SELECT pos, alt, CAST(col AS INT) AS col, CASE WHEN contains(gt, '|') THEN 1 ELSE 0 END AS phase,
                CASE WHEN substr(gt, 1, 1) = o THEN 1 ELSE 0 END AS gt1, CASE WHEN substr(gt, 3, 1) = o THEN 1 ELSE 0 END AS gt2
              FROM (SELECT *, 'C' AS alt, '1' AS o FROM wide UNION ALL SELECT *, 'GT', '2' FROM wide WHERE two)) WHERE gt1 + gt2 > 0
            UNION ALL SELECT NULL, 'ALT', CAST(k AS INT), concat('n', k), 0, 0, 0 FROM (SELECT unnest(range(7)) AS k)"""),
        "info_by_allele": """SELECT p_partkey + 1 AS pos, substr('CGT', CAST(i AS INT), 1) AS alt, p_partkey % 50 + i AS ac,
            CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 90 END AS dp, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS db,
            CAST(i AS INT) AS af10, p_partkey % 50 * 2 + 1 AS rc_ref, p_partkey % 50 * 2 + i + 1 AS rc_alt,
            p_partkey % 50 * 3 + 1 AS gl_0, p_partkey % 50 * 3 + i * (i + 1) // 2 + 1 AS gl_1,
            p_partkey % 50 * 3 + i * (i + 1) // 2 + i + 1 AS gl_2, CASE WHEN p_partkey % 3 = 0 THEN 'a+b' END AS tag
            FROM (SELECT *, unnest(range(1, p_size % 3 + 2)) AS i FROM part)""",
        "carrier_density": _with("vcall", """SELECT m AS max_carriers, n AS n_samples,
            CASE WHEN m * 20 > n THEN 1 ELSE 0 END AS dense FROM (SELECT max(c) AS m FROM (
            SELECT count(*) AS c FROM vcall GROUP BY pos)), (SELECT count(*) AS n FROM supplier)"""),
        "carrier_union": _with("vcall", """SELECT pos AS site_id, sample_id, phase, gt1, gt2
            FROM vcall WHERE gt1 = 1 OR phase = 1"""),
        "graph_stats": _with("segm edg klass", """SELECT 'x' AS chrom, length AS ref_length,
            (SELECT count(*) FROM segm) AS vertices,
            (SELECT CAST(sum(length) AS BIGINT) FROM segm) AS seq_length,
            (SELECT count(*) FROM edg) AS edges, (SELECT count(*) FROM site) AS mutations,
            (SELECT count(*) FROM vcall) AS mutation_samples,
            (SELECT count(DISTINCT class_id) FROM klass) AS sample_classes FROM len"""),
        "segments": _with("segm", "SELECT seg_id, kind, ref_start, ref_end, length, seq FROM segm"),
        "edges": _with("edg", "SELECT src, dst FROM edg"),
        "all_vertices": _with("edg", "SELECT DISTINCT src AS seg_id FROM edg"),
        "out_neighbors": _with("roots edg", """SELECT r.seg_id, e.dst AS neighbor FROM (
            SELECT DISTINCT seg_id FROM roots) r JOIN edg e ON e.src = r.seg_id"""),
        "in_neighbors": _with("roots edg", """SELECT r.seg_id, e.src AS neighbor FROM (
            SELECT DISTINCT seg_id FROM roots) r JOIN edg e ON e.dst = r.seg_id"""),
        "out_degree": _with("edg", "SELECT src AS seg_id, count(*) AS degree FROM edg GROUP BY 1"),
        "in_degree": _with("edg", "SELECT dst AS seg_id, count(*) AS degree FROM edg GROUP BY 1"),
        "is_edge": _with("edg", """SELECT src, dst FROM edg WHERE src % 2 = 0 AND dst - src IN (2, 4)"""),
        "neighbor_intersection": _with("edg", """SELECT a.src AS "left", a.dst AS "right", b.dst AS common
            FROM edg a JOIN edg b ON b.src = a.src JOIN edg c ON c.src = a.dst AND c.dst = b.dst"""),
        "neighbor_order": _with("edg", "SELECT src, dst, CAST(1 - dst % 2 AS INT) AS is_ref FROM edg"),
        "bfs_radius": _with("roots edg", _reach(4) + " SELECT root, seg_id, hops FROM found", True),
        "path_step": _with("coord rseg", """SELECT r.seg_id AS src, c.sample_id,
            CASE WHEN alt <> '' THEN 2 * c.pos + 1 ELSE 2 * (c.hi + 1) END AS dst, 1 AS on_variant
            FROM coord c JOIN rseg r ON r.ref_end = c.lo - 1"""),
        "dot_lines": _with("roots edg segm mark", _reach(2) + """,
            node AS (SELECT f.root, g.* FROM found f JOIN segm g ON g.seg_id = f.seg_id),
            marked AS (SELECT root, seg_id, CAST(-1 AS BIGINT) AS sample_id, 'ref' AS name,
                ref_start AS idx FROM node WHERE kind = 'REF' UNION ALL
              SELECT n.root, n.seg_id, m.sample_id, s.s_name, m.idx FROM node n
              JOIN mark m ON m.seg_id = n.seg_id JOIN supplier s ON s.s_suppkey = m.sample_id),
            tagged AS (SELECT *, min(sample_id) OVER (PARTITION BY root, seg_id) AS f,
                max(sample_id) OVER (PARTITION BY root, seg_id) AS l FROM marked),
            rooted AS (SELECT DISTINCT root FROM node)
            SELECT root, CAST(1 AS BIGINT) AS section, seg_id AS a, CAST(-2 AS BIGINT) AS b,
              concat(seg_id, '[ label="', seg_id, ' l:', length) AS line FROM node UNION ALL
            SELECT root, 1, seg_id, sample_id, concat(CASE WHEN sample_id = f THEN '(' ELSE '' END, name,
              ' i:', idx, CASE WHEN sample_id = l THEN ')"]' ELSE '' END) FROM tagged UNION ALL
            SELECT n.root, CASE WHEN e.src % 2 = 0 AND e.dst % 2 = 0 THEN 3 ELSE 5 END, e.src, e.dst,
              concat(CASE WHEN e.src % 2 = 0 AND e.dst % 2 = 0 THEN chr(9) || chr(9) ELSE chr(9) END,
                     e.src, ' -> ', e.dst) FROM node n JOIN edg e ON e.src = n.seg_id UNION ALL
            SELECT root, 0, 0, 0, 'digraph {' FROM rooted UNION ALL
            SELECT root, 2, 0, 0, chr(9) || 'subgraph cluster_0 {' FROM rooted UNION ALL
            SELECT root, 2, 1, 0, chr(9) || chr(9) || 'label="reference";' FROM rooted UNION ALL
            SELECT root, 4, 0, 0, chr(9) || '}' FROM rooted UNION ALL
            SELECT root, 6, 0, 0, '}' FROM rooted""", True),
        "vertex_info": _with("segm mark named klass", """SELECT g.seg_id, coalesce(m.part, 0) AS part,
            concat('ID: ', g.seg_id, ' Offset: ', g.ref_start, ' length: ', g.length, ' sample_class: ',
              coalesce(k.class_id, 0), ' Samples: ', coalesce(m.txt, '')) AS info
            FROM segm g LEFT JOIN klass k ON k.site_id = g.site_id LEFT JOIN (
              SELECT m.seg_id, m.sample_id // 65536 AS part, string_agg(concat('Sample id: ', n.name,
                ' Sample phase: ', n.phasing, ' Index: ', m.idx, ' '), '' ORDER BY m.sample_id) AS txt
              FROM mark m JOIN named n ON n.pos = m.site_id AND n.sample_id = m.sample_id GROUP BY 1, 2) m
            ON m.seg_id = g.seg_id"""),
        "allele_classify": _with("made", """SELECT p_partkey, ref, alt,
            CASE WHEN length(ref) = length(alt) THEN 'SUB' WHEN length(ref) > length(alt) THEN 'DEL'
              ELSE 'INS' END AS kind,
            CASE WHEN length(ref) = length(alt) THEN 'SUBSTITUTION' WHEN length(ref) > length(alt)
              THEN 'DELETION' ELSE 'INSERTION' END AS kind_name,
            CASE WHEN regexp_matches(alt, '^[ACTG]+$') THEN 1 ELSE 0 END AS plain FROM made"""),
        "allele_trim": _with("made", """SELECT p_partkey,
            p_partkey + 1 + CASE kind WHEN 'INS' THEN n - 1 WHEN 'DEL' THEN m ELSE 0 END AS pos, kind,
            CASE kind WHEN 'INS' THEN '' WHEN 'DEL' THEN substr(ref, m + 1) ELSE ref END AS ref,
            CASE kind WHEN 'DEL' THEN '' WHEN 'INS' THEN substr(alt, n + 1) ELSE alt END AS alt,
            m - n AS delta FROM (SELECT *, length(ref) AS n, length(alt) AS m,
              CASE WHEN length(ref) = length(alt) THEN 'SUB'
                WHEN length(ref) > length(alt) AND starts_with(ref, alt) THEN 'DEL'
                WHEN length(ref) < length(alt) AND starts_with(alt, ref) THEN 'INS'
                ELSE 'CPX' END AS kind FROM made)"""),
        "gt_decode": _with("gtp", """SELECT l_orderkey, l_linenumber, gt, ordinal,
            CASE WHEN contains(gt, '|') THEN 1 ELSE 0 END AS phase,
            CASE WHEN p[1] = ordinal THEN 1 ELSE 0 END AS gt1,
            CASE WHEN p[2] = ordinal THEN 1 ELSE 0 END AS gt2,
            CASE WHEN length(gt) IN (1, 3) AND p[1] > 0 THEN 1 ELSE 0 END AS any1,
            CASE WHEN length(gt) IN (1, 3) AND p[2] > 0 THEN 1 ELSE 0 END AS any2 FROM gtp"""),
        "gt_predicates": _with("gtp", """SELECT l_orderkey, l_linenumber, gt, CAST(len(p) AS INT) AS ploidy,
            CASE WHEN h THEN 1 ELSE 0 END AS is_hom, CASE WHEN h THEN 0 ELSE 1 END AS is_het,
            CASE WHEN coalesce(p[1], 0) > 0 OR coalesce(p[2], 0) > 0 THEN 1 ELSE 0 END AS has_non_ref,
            CASE WHEN contains(gt, '.') THEN 1 ELSE 0 END AS is_missing,
            CASE WHEN len(list_filter(p, lambda x: x IS NULL OR x <> 0)) = 0 THEN 1 ELSE 0 END AS is_hom_ref,
            CASE WHEN h AND p[1] > 0 AND NOT contains(gt, '.') THEN 1 ELSE 0 END AS is_hom_non_ref
            FROM (SELECT *, len(p) = 1 OR p[1] IS NOT DISTINCT FROM p[2] AS h FROM gtp)"""),
        "phasing_string": _with("named", "SELECT pos, sample_id, phasing FROM named"),
        "base_code": """SELECT p_partkey, l AS letter, c AS code,
            CASE c WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'T' WHEN 3 THEN 'G' WHEN 4 THEN 'N' ELSE '?' END AS back
            FROM (SELECT p_partkey, l, CASE l WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'T' THEN 2 WHEN 'G' THEN 3
              WHEN 'N' THEN 4 ELSE 5 END AS c FROM (SELECT p_partkey, upper(substr(p_name, 1, 1)) AS l FROM part))""",
        "contig_match": """SELECT c_custkey, name, CASE WHEN name IN ('x', 'chrx', 'CHRx') THEN 1 ELSE 0 END AS matches
            FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'chrx' WHEN 2 THEN 'CHRx'
              WHEN 3 THEN 'chrxx' ELSE '' END AS name FROM customer)""",
        "ref_validate": _with("ref_base", """SELECT b.pos FROM ref_base b
            LEFT JOIN ref_base n ON n.pos = b.pos + 1 LEFT JOIN ref_base m ON m.pos = b.pos + 2
            WHERE (b.pos % 3 = 1 AND n.base IS DISTINCT FROM 'A')
               OR (b.pos % 3 = 2 AND (n.base IS DISTINCT FROM 'C' OR m.base IS DISTINCT FROM 'G'))"""),
        "region_parse": """SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY x, y) - 1 AS ordinal,
            x, y FROM (SELECT c_custkey, c_custkey % 100 + 5 AS x, c_custkey % 100 + 50 AS y FROM customer UNION ALL
              SELECT c_custkey, c_custkey % 37 + 1, 0 FROM customer UNION ALL
              SELECT c_custkey, c_custkey % 11 + 1, c_custkey % 11 + 9 FROM customer)""",
        "sequence_list_parse": """SELECT p_partkey, CAST(i - 1 AS BIGINT) AS ordinal, w[i] AS sequence FROM (
            SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (
              SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))""",
        "normalized_calls": _with("site", """SELECT s.pos, s.kind, s.ref, s.alt, s.delta, v.sample_id, v.phase,
            v.gt1, v.gt2 FROM site s JOIN vcall v ON v.pos = s.pos"""),
        "vcf_text_parse": _with("raw", """SELECT 'x' AS chrom, r.pos, r.ref, r.alt, v.sample_id, v.phase, v.gt1,
            v.gt2 FROM raw r JOIN vcall v ON v.pos = r.site_id"""),
        "fasta_text_parse": _with("ref_base", """SELECT 'x' AS chrom, (pos - 1) // 256 AS cell,
            (pos - 1) // 256 * 256 + 1 AS start, string_agg(base, '' ORDER BY pos) AS bases
            FROM ref_base GROUP BY 1, 2, 3"""),
        "variant_tsv": _with("req site named", """SELECT q.region_id, concat(s.pos, chr(9), s.ref, chr(9), s.alt, chr(9),
            string_agg(concat(n.name, '(', n.phasing, ') '), '' ORDER BY n.sample_id)) AS line
            FROM req q JOIN site s ON s.pos >= q.x AND s.pos < q.y JOIN named n ON n.pos = s.pos
            GROUP BY q.region_id, s.pos, s.ref, s.alt, n.sample_id // 65536"""),
        "dedupe_variants": _with("site", """SELECT s.pos, s.ref, s.alt, min(v.sample_id) AS first_id
            FROM site s JOIN vcall v ON v.pos = s.pos GROUP BY 1, 2, 3"""),
        "unseen_variants": _with("site", """SELECT pos, ref, alt FROM site s WHERE NOT EXISTS (
            SELECT 1 FROM vcall v WHERE v.pos = s.pos AND (v.sample_id + v.pos) % 37 = 0)"""),
        "multiset_count": """SELECT l_partkey AS key, l_suppkey AS value, count(*) AS count FROM lineitem GROUP BY 1, 2""",
        "multiset_merge": """SELECT l_partkey AS key, l_linenumber AS value, count(*) AS count FROM lineitem
            GROUP BY 1, 2""",
        "multiset_intersect": _with("cnt", """SELECT a.key, a.value, least(a.count, b.count) AS count FROM cnt a
            JOIN cnt b ON a.key = b.key AND a.value = b.value WHERE a.l_linestatus = 'O' AND b.l_linestatus = 'F'"""),
        "multiset_remove": """SELECT key, value, n AS count FROM (SELECT l_partkey AS key, l_suppkey AS value,
            CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) AS BIGINT) AS n FROM lineitem
            WHERE l_linestatus IN ('O', 'F') GROUP BY 1, 2) WHERE n > 0""",
        "multiset_delete": _with("cnt", """SELECT key, value, count FROM cnt a WHERE l_linestatus = 'O' AND NOT EXISTS (
            SELECT 1 FROM cnt b WHERE b.l_linestatus = 'F' AND b.key = a.key AND b.value = a.value)"""),
        "multiset_replace": _with("cnt", """SELECT key, v AS value, CAST(sum(n) AS BIGINT) AS count FROM (
            SELECT a.key, a.n, CASE WHEN b.key IS NULL THEN a.value ELSE a.value % 7 END AS v FROM (
              SELECT l_partkey AS key, l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1, 2) a
            LEFT JOIN cnt b ON b.l_linestatus = 'F' AND b.key = a.key AND b.value = a.value) GROUP BY 1, 2"""),
        "multiset_lookup": """SELECT l_partkey AS key, l_suppkey AS value,
            count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS count FROM lineitem GROUP BY 1, 2""",
        "inner_product": _with("cnt", """SELECT CAST(sum(a.count * b.count) AS BIGINT) AS inner_product FROM cnt a
            JOIN cnt b ON a.key = b.key AND a.value = b.value WHERE a.l_linestatus = 'O' AND b.l_linestatus = 'F'"""),
        "magnitude": """SELECT CAST(sum(n * n) AS BIGINT) AS squared_magnitude FROM (
            SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)""",
        "multiset_summary": """SELECT count(*) AS distinct_entries, CAST(sum(n) AS BIGINT) AS total_count FROM (
            SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)""",
        "hist_mean_std": """SELECT b AS bin_upto, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (
            SELECT o_orderkey % 1000 AS v, CASE WHEN c = 0 THEN 400 ELSE (c + 399) // 400 * 400 END AS b
            FROM (SELECT *, o_custkey % 2600 AS c FROM orders) WHERE c <= 2400) GROUP BY 1""",
    }
    return out
