"""Plain SQL for the runs in `plans.catalog`, written independently over the same Parquet tables."""

from __future__ import annotations

from tomoloom.functions.text import STOPWORDS
from tomoloom.operators.heat import RAMP
from tomoloom.plans.derived import CONCEPTS

# Derived tables, each stated once; a check names those it needs and they are put in front of it in this order.
_TABLES = {
    "volume": """
        select concat('scan_', vec_id // 250) volume_id, (vec_id % 250)::int z, (p // 8)::int y, (p % 8)::int x,
          e::double v, floor((e::double + 1) * 1000)::int g
        from (select vec_id, unnest(embedding) e, generate_subscripts(embedding, 1) - 1 p from embeddings)""",
    "mask": "select volume_id, z, y, x, (v >= 0.05)::int::tinyint m from volume",
    "truth": "select volume_id, z, y, x, (v >= 0.08)::int::tinyint m from volume",
    "files": """
        select concat(source, '/', lang, '/doc_', doc_id::varchar,
            case doc_id % 5 when 0 then '.TIF' when 1 then '.npy' when 2 then '.json' when 3 then '.stl' else '' end) path,
          source folder,
          case doc_id % 5 when 0 then '.tif' when 1 then '.npy' when 2 then '.json' when 3 then '.stl' else '' end ext,
          md5(text) content_md5 from documents""",
    "word_box": """
        select doc_id, (p // 400)::int + 1 page_no, p::int word_no,
          ((p % 10) * 60)::double x0, (((p % 400) // 10) * 18)::double y0,
          ((p % 10) * 60 + 5 * length(word))::double x1, (((p % 400) // 10) * 18 + 12)::double y1, word
        from (select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 p
              from (select doc_id, regexp_split_to_array(text, '[ \n]+') w from documents)) where word <> ''""",
    "clean": "select *, lower(regexp_replace(word, '[^A-Za-z-]', '', 'g')) c from word_box",
    "concept": "select * from (values {concepts}) t(ord, concept)",
    "vocab": """
        select c, arg_min(concept, ord) concept from (select distinct c from clean where c <> '') join concept
        on c = concept or (length(c) >= 4 and length(concept) >= 4 and (starts_with(c, concept) or starts_with(concept, c)))
        group by c""",
    "hit": "select clean.*, vocab.concept from clean join vocab using (c)",
    "page_hit": "select doc_id, page_no, count(*) n_hits from hit group by all",
    "term": """
        select doc_id, w concept, n, (row_number() over (partition by doc_id order by n desc, first) - 1)::int ord from (
          select doc_id, lower(t) w, count(*) n, min(word_no * 1000 + i) first from (
            select doc_id, word_no, unnest(ts) t, generate_subscripts(ts, 1) i
            from (select doc_id, word_no, regexp_extract_all(word, '[A-Za-z]+') ts from word_box))
          where length(t) >= 5 and lower(t) not in ({stopwords}) group by all)
        qualify ord < 14""",
    "splat": """
        select doc_id, page_no, y, x, sum(w) w from (
          select doc_id, page_no, trunc((y0 + y1) / 2 * 2.2::double)::int y, trunc((x0 + x1) / 2 * 2.2::double)::int x,
            least(1.8, 1.0 + 0.4 * greatest(0, (x1 - x0) * 2.2::double - 20) / 40)::double w from hit)
        where x < 1254 and y < 1584 group by all""",
    "kernel": """
        select k, e / sum(e) over () e from (
          select k, exp(-0.5 * (k / 2.0) * (k / 2.0)) e from (select unnest(generate_series(-8, 8)) k))""",
    "rows_blurred": """
        select doc_id, page_no, x, case when yy < 0 then -1 - yy when yy >= 1584 then 3167 - yy else yy end y, sum(w * e) w
        from (select *, y + k yy from splat, kernel) group by all""",
    "blurred": """
        select doc_id, page_no, y, case when xx < 0 then -1 - xx when xx >= 1254 then 2507 - xx else xx end x, sum(w * e) w
        from (select *, x + k xx from rows_blurred, kernel) group by all""",
    "toned": """
        select *, case when norm < 0.10 then 0.0 else norm * 0.68::double end alpha
        from (select *, least(1.0, w / (4.0 / (2 * pi() * 4.0)))::double norm from blurred)""",
    "coloured": """
        select *, {r} r, {g} g, {b} b from toned""",
    "dot": """
        select doc_id, page_no, y, x, min(shade) gray from (
          select doc_id, page_no, trunc((y0 + y1) / 2 * 2.2::double)::int y, trunc((x0 + x1) / 2 * 2.2::double)::int x,
            greatest(0, 255 - 8 * length(word)) shade from word_box) where x < 1254 group by all""",
    "strut": """
        select concat('scan_', o_orderkey % 8) graph_id, o_orderkey strut_id, (o_orderkey % 8)::double x0,
          (o_custkey % 8)::double y0, (o_orderkey % 250)::double z0, ((o_orderkey + o_custkey) % 8)::double x1,
          ((o_orderkey * 3 + o_custkey) % 8)::double y1, ((o_orderkey % 250 + o_custkey % 12) % 250)::double z1
        from orders""",
    "coverage": """
        select graph_id, strut_id, count(*) voxels, count(m) filled, count(m) = 0 missing,
          count(m) > 0 and count(m) < 0.9 * count(*) broken
        from (select distinct graph_id, strut_id, floor(0.5 + z0 + (z1 - z0) * i / greatest(n, 1))::int z,
                floor(0.5 + y0 + (y1 - y0) * i / greatest(n, 1))::int y, floor(0.5 + x0 + (x1 - x0) * i / greatest(n, 1))::int x
              from (select *, unnest(generate_series(0, n)) i from (
                select *, greatest(abs(z1 - z0), abs(y1 - y0), abs(x1 - x0))::int n from strut))) p
        left join (select volume_id, z, y, x, m from mask where m = 1) s
          on s.volume_id = p.graph_id and s.z = p.z and s.y = p.y and s.x = p.x group by all""",
    "triangle": """
        select concat('mesh_', o_orderstatus) mesh_id, o_orderkey tri_id,
          (o_orderkey % 97)::double ax, (o_orderkey % 89)::double ay, (o_orderkey % 50)::double az,
          (o_custkey % 83)::double bx, (o_custkey % 79)::double "by", (o_custkey % 50)::double bz,
          ((o_orderkey + o_custkey) % 73)::double cx, ((o_orderkey + o_custkey) % 71)::double cy,
          ((o_orderkey + o_custkey) % 50)::double cz from orders""",
    "extent": """
        select mesh_id, count(*) n_triangles, min(least(az, bz, cz)) z_min, max(greatest(az, bz, cz)) z_max,
          (min(least(az, bz, cz)) + max(greatest(az, bz, cz))) / 2 z_mid from triangle group by all""",
    "graph_doc": """
        select vec_id graph_no, label, vec_id % 2 = 0 even,
          [floor((e::double + 1) * 1000) for e, i in embedding if i % 3 = 1 and i < 64] xs,
          [floor((e::double + 1) * 1000) / 2 for e, i in embedding if i % 3 = 2 and i < 64] ys,
          [floor((e::double + 1) * 1000) / 4 for e, i in embedding if i % 3 = 0 and i < 64] zs from embeddings""",
    "graph_doc_profile": """
        select graph_no, 21::bigint junctions, label::bigint struts, case when even then 2 else 0 end::bigint unit_cells,
          list_min(xs) min_x, list_min(ys) min_y, list_min(zs) min_z, list_max(xs) max_x, list_max(ys) max_y,
          list_max(zs) max_z from graph_doc""",
    "log_item": """
        select conv_id, turn, 2::int str_no, unnest([0, 0, 1])::int call_no, unnest(['query', 'query', 'pattern']) kind,
          unnest([0, 1, 0])::int item_no,
          unnest([concat(role, ' lattice (turn ', turn, ')'), translate(text, '()', '[]'), concat('conv ', conv_id % 5)]) "text"
        from conversations where conv_id % 11 <> 3 and conv_id % 13 <> 5""",
    "keyword": """
        select * from (select kind, conv_id, turn, call_no, item_no, "text" from log_item where "text" <> '')
        qualify row_number() over (partition by kind, "text" order by conv_id, turn, call_no, item_no) = 1""",
    "log_line": """
        select conv_id, turn, (conv_id % 8)::int part, row_number() over (partition by conv_id % 8 order by conv_id, turn) line_num
        from conversations""",
    "degree": """
        select a.volume_id, a.z, a.y, a.x, (count(*) - 1)::int degree
        from (select * from mask where m = 1) a join (select * from mask where m = 1) b
          on a.volume_id = b.volume_id and b.z between a.z - 1 and a.z + 1
          and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by all""",
    "kinds": """
        select *, case degree when 0 then 'isolated' when 1 then 'end' when 2 then 'link' else 'junction' end kind
        from degree""",
    "stack": """
        select 'scan' volume_id, vec_id::int z, (p // 8)::int y, (p % 8)::int x, e::float v
        from (select vec_id, unnest(embedding) e, generate_subscripts(embedding, 1) - 1 p from embeddings)""",
    "solid": "select volume_id, z, y, x, (z::bigint << 42) + (y::bigint << 21) + x p from {voxels} where v >= {solid}",
    "touch": """
        select a.volume_id, a.p a, b.p b, a.d from (
          select *, z + dz bz, y + dy b_y, x + dx bx, abs(dz) + abs(dy) + abs(dx) d from solid, (
            select unnest([-1, 0, 1])::int dz) q, (select unnest([-1, 0, 1])::int dy) r, (select unnest([-1, 0, 1])::int dx) s) a
        join solid b on b.volume_id = a.volume_id and b.z = bz and b.y = b_y and b.x = bx where d > 0""",
    "part": """
        select volume_id, p, p from solid union
        select t.volume_id, t.b, min(c.root) from part c join touch t on t.volume_id = c.volume_id and t.a = c.p
          join recurring.part r on r.volume_id = t.volume_id and r.p = t.b where c.root < r.root group by all""",
    "voxel": """
        select volume_id, p, case count(b) when 0 then 'isolated' when 1 then 'end' when 2 then 'link' else 'junction' end kind
        from solid left join (select volume_id, a p, b from touch) using (volume_id, p) group by all""",
    "named": """
        select t.volume_id, a, b, d, v.kind a_kind, w.kind b_kind from touch t
        join voxel v on v.volume_id = t.volume_id and v.p = a join voxel w on w.volume_id = t.volume_id and w.p = b""",
    "item": """
        select volume_id, p, p from solid union
        select t.volume_id, t.b, min(c.root) from item c join named t on t.volume_id = c.volume_id and t.a = c.p
          join recurring.item r on r.volume_id = t.volume_id and r.p = t.b
        where a_kind = b_kind and a_kind in ('link', 'junction') and c.root < r.root group by all""",
    "branch_step": """
        select n.volume_id, case when a_kind = 'link' then i.root when b_kind = 'link' then j.root when a_kind = 'end' then a else b end branch, d
        from named n join item i on i.volume_id = n.volume_id and i.p = a join item j on j.volume_id = n.volume_id and j.p = b
        where a < b and not (a_kind = 'junction' and b_kind = 'junction')""",
    "branch_end": """
        select n.volume_id, i.root branch, j.root node from named n join item i on i.volume_id = n.volume_id and i.p = a
          join item j on j.volume_id = n.volume_id and j.p = b where a_kind = 'link' and b_kind <> 'link'
        union all select n.volume_id, case when a_kind = 'end' then a else b end, unnest([i.root, j.root]) from named n
          join item i on i.volume_id = n.volume_id and i.p = a join item j on j.volume_id = n.volume_id and j.p = b
        where a < b and a_kind <> 'link' and b_kind <> 'link' and (a_kind = 'end' or b_kind = 'end')""",
    "cell": """
        select distinct volume_id, 2 * z + dz cz, 2 * y + dy cy, 2 * x + dx cx from solid, (select unnest([0, 1, 2]) dz) q,
          (select unnest([0, 1, 2]) dy) r, (select unnest([0, 1, 2]) dx) s""",
    "euler": """
        select volume_id, sum(case when (cz + cy + cx) % 2 = 0 then 1 else -1 end)::bigint euler_number from cell group by all""",
    "profile": """
        select volume_id, max(z) + 1 nz, max(y) + 1 ny, max(x) + 1 nx, count(*) n_voxels, min(g)::double min_v,
          max(g)::double max_v, sum(g)::double / count(*) mean_v from volume group by all""",
    "agreement": """
        select volume_id, count(*) filter (r.m = 1 and t.m = 1) tp, count(*) filter (r.m = 1 and t.m = 0) fp,
          count(*) filter (r.m = 0 and t.m = 1) fn from mask r join truth t using (volume_id, z, y, x) group by all""",
    "sweep": """
        select volume_id, threshold, count(*) n_voxels, count(*) filter (v >= threshold) foreground_voxels
        from volume, (select unnest([-0.1, 0.0, 0.05, 0.1]::double[]) threshold) group by all""",
    "binned": """
        select volume_id, lo, hi, case when v < lo + i * ((hi - lo) / {bins}) then i - 1
            when i < {bins} - 1 and v >= lo + (i + 1) * ((hi - lo) / {bins}) then i + 1 else i end bin
        from (select volume_id, v, lo, hi, least(floor((v - lo) / (hi - lo) * {bins}), {bins} - 1)::int i
              from volume join (select volume_id, min(v) lo, max(v) hi from volume group by all) using (volume_id))""",
    "split": """
        select *, w1::double * w2::double * ((s1::double / w1 - s2::double / w2) * (s1::double / w1 - s2::double / w2)) b
        from (select volume_id, level, n, sum(n) over up w1, sum(level * n) over up s1,
                sum(n) over (partition by volume_id) - sum(n) over up w2,
                sum(level * n) over (partition by volume_id) - sum(level * n) over up s2
              from (select volume_id, {level} level, count(*) n from {levels_from} group by all)
              window up as (partition by volume_id order by level)) where w2 > 0""",
    "threshold": """
        select volume_id, arg_max(level, (b, -level)) threshold from split group by all""",
    "first_copy": "select content_md5, min(path) first_path from files group by all",
    "first_volume_copy": """
        select content_md5, min(path) first_path from files where ext in ('.tif', '.npy') group by all""",
}


def _channel(i: int) -> str:
    arms = " ".join(
        f"when norm < {t1}::double then {c0[i]} + (norm - {t0}::double) / {t1 - t0!r}::double * {c1[i] - c0[i]}"
        for (t0, c0), (t1, c1) in zip(RAMP[:-1], RAMP[1:], strict=True)
    )
    return f"case {arms} else {RAMP[-1][1][i]} end"


_FILL = {
    "concepts": ", ".join(f"({i}, '{c}')" for i, c in enumerate(CONCEPTS)),
    "voxels": "volume",
    "stopwords": ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS)),
    "r": _channel(0),
    "g": _channel(1),
    "b": _channel(2),
}

#: Tables that refer to themselves keep one row per key, its latest.
_RECURSIVE = {name: f"{name}(volume_id, p, root) using key (volume_id, p)" for name in ("part", "item")}

_checks: dict[str, str] = {}


def _check(name: str, needs: str, sql: str, **fill) -> None:
    wanted = needs.split()
    parts = []
    for table, body in _TABLES.items():
        if table in wanted:
            for key, value in {**_FILL, **fill}.items():
                body = body.replace("{" + key + "}", str(value))
            kept = "materialized " if table in ("solid", "touch", "voxel", "named") else ""
            parts.append(f"{_RECURSIVE.get(table, table)} as {kept}({body})")
    recursive = "recursive " if set(wanted) & set(_RECURSIVE) else ""
    _checks[name] = (f"with {recursive}{', '.join(parts)} " if parts else "") + sql


def all_checks() -> dict[str, str]:
    return dict(_checks)


_HITS = "word_box clean concept vocab hit"
_STATS = "count(*) filter (m <> 0) foreground_voxels, count(*) filter (m = 0) background_voxels"

_check("segment_foreground", "volume mask", f"select volume_id, {_STATS} from mask group by all")
_check("segment_mask_slice", "volume mask", 'select volume_id, y "row", x col, m from mask where z = 3')
_check("slice_axis0", "volume", 'select volume_id, y "row", x col, v from volume where z = 7')
_check("slice_axis1", "volume", 'select volume_id, z "row", x col, v from volume where y = 2')
_check("slice_axis2", "volume", 'select volume_id, z "row", y col, v from volume where x = 5')
_check(
    "slice_gray",
    "volume",
    """select volume_id, y "row", x col, floor((v - min(v) over w) / (max(v) over w - min(v) over w) * 255)::int gray
    from volume where z = 7 window w as (partition by volume_id)""",
)
_check(
    "slice_extent",
    "volume",
    "select volume_id, max(y) + 1 n_rows, max(x) + 1 n_cols, min(v) min_v, max(v) max_v from volume where z = 7 group by all",
)
_check("volume_profile", "volume profile", "select * from profile")
_check(
    "volume_histogram200",
    "volume binned",
    """select volume_id, i bin, lo + i * ((hi - lo) / 200) lower,
      case when i = 199 then hi else lo + (i + 1) * ((hi - lo) / 200) end upper, coalesce(n, 0) voxels
    from (select distinct volume_id, lo, hi, i from binned, (select unnest(generate_series(0, 199))::int i))
    left join (select volume_id, bin i, count(*) n from binned group by all) using (volume_id, i)""",
    bins=200,
)
_check("otsu_threshold", "volume split threshold", "select * from threshold", level="g::bigint", levels_from="volume")
_check(
    "otsu_threshold_binned",
    "volume binned split threshold",
    """select volume_id, (lo + threshold * ((hi - lo) / 256) + lo + (threshold + 1) * ((hi - lo) / 256)) / 2 threshold
    from threshold join (select distinct volume_id, lo, hi from binned) using (volume_id)""",
    level="bin::bigint",
    levels_from="binned",
    bins=256,
)
_check(
    "otsu_mask_count",
    "volume split threshold",
    """select volume_id, count(*) filter (g > threshold) foreground_voxels, count(*) filter (g <= threshold) background_voxels
    from volume join threshold using (volume_id) group by all""",
    level="g::bigint",
    levels_from="volume",
)
_check("threshold_sweep", "volume sweep", "select * from sweep")
_check(
    "segment_float32_edge",
    "volume",
    """select volume_id, threshold, count(*) n_voxels, count(*) filter (t >= round(threshold * 10)::int) foreground_voxels
    from (select volume_id, (sign(v) * floor(abs(v * 10) + 0.5))::int t from volume),
      (select unnest([0.1, 0.2, 0.3, 0.7]::double[]) threshold) group by all""",
)
_check(
    "positive_mask_stats",
    "volume",
    """select volume_id, count(*) filter (v > 0) foreground_voxels, count(*) filter (v <= 0) background_voxels
    from volume group by all""",
)
_check("foreground_check", "volume mask", "select volume_id, bool_or(m <> 0) has_foreground from mask group by all")
_check(
    "mask_compare",
    "volume mask truth agreement",
    """select volume_id, tp true_positives, fp false_positives, fn false_negatives, tp / (tp + fp + fn) iou,
      2 * tp / (2 * tp + fp + fn) dice from agreement""",
)
_check("file_ext_counts", "files", "select case ext when '' then '(no ext)' else ext end ext, count(*) files from files group by 1")
_check("file_folders", "files", "select distinct folder from files")
_check(
    "file_duplicates",
    "files first_copy",
    "select path, content_md5, first_path, path <> first_path is_duplicate from files join first_copy using (content_md5)",
)
_check(
    "volume_file_duplicates",
    "files first_volume_copy",
    """select path, content_md5, first_path, path <> first_path is_duplicate from files
    join first_volume_copy using (content_md5) where ext in ('.tif', '.npy')""",
)
_check(
    "file_slugs",
    "",
    "select doc_id, concat(lang, '_v2__', doc_id::varchar) slug, '.pdf' ext from documents",
)
_check(
    "graph_profile",
    "",
    """select graph_id, count(*) filter (k = 'j') junctions, count(*) filter (k = 's') struts,
      count(*) filter (k = 'c') unit_cells, min(x) min_x, min(y) min_y, min(z) min_z, max(x) max_x, max(y) max_y, max(z) max_z
    from (select concat('graph_', c_nationkey) graph_id, 'j' k, (c_custkey % 41)::double x, (c_custkey % 37)::double / 2 y,
            c_acctbal z from customer
          union all select concat('graph_', p_partkey % 23), 's', null, null, null from part
          union all select concat('graph_', s_nationkey), 'c', null, null, null from supplier) group by all""",
)
_check("graph_json_profile", "graph_doc graph_doc_profile", "select * from graph_doc_profile")
_check("strut_coverage", "volume mask strut coverage", "select * from coverage")
_check(
    "strut_defects",
    "volume mask strut coverage",
    """select graph_id, count(*) struts, count(*) filter (missing) missing, count(*) filter (broken) broken,
      count(*) filter (missing) * 100.0::double / count(*) missing_percent from coverage group by all""",
)
_check(
    "node_degree",
    "strut",
    """select graph_id, x, y, z, count(*) degree from (select graph_id, x0 x, y0 y, z0 z from strut
    union all select graph_id, x1, y1, z1 from strut) group by all""",
)
_check("mesh_zrange", "triangle extent", "select * from extent")


def _crossing(plane: str, source: str) -> str:
    def cut(a: str, b: str, d: str) -> str:
        return f'"{a}{d}" + (({plane} - {a}z) / ({b}z - {a}z)) * ("{b}{d}" - "{a}{d}")'

    above = {v: f"({v}z > {plane})" for v in "abc"}
    ends = ", ".join(
        f"case when {above['a']} <> {above['b']} then {cut('a', 'b', d)} else {cut('b', 'c', d)} end {d}0, "
        f"case when {above['c']} <> {above['a']} then {cut('c', 'a', d)} else {cut('b', 'c', d)} end {d}1"
        for d in "xy"
    )
    count = " + ".join(f"{above[v]}::int" for v in "abc")
    return f"select mesh_id, tri_id, {ends} from {source} where {count} between 1 and 2"


_check("mesh_crossing", "triangle extent", _crossing("z_mid", "triangle join extent using (mesh_id)"))
_check("mesh_crossing_through_vertices", "triangle", _crossing("25.0", "triangle"))
_check(
    "prompt_concepts",
    "",
    """select doc_id, lower(t) concept, min(i - 1)::int ord from (
      select doc_id, unnest(ts) t, generate_subscripts(ts, 1) i
      from (select doc_id, regexp_extract_all(text, '[A-Za-z]+') ts from documents))
    where lower(t) not in ({stopwords}) and (length(t) >= 3 or (length(t) >= 2 and upper(t) = t)) group by 1, 2""".replace(
        "{stopwords}", _FILL["stopwords"]
    ),
)
_check(
    "file_prompts",
    "",
    """select doc_id set_id, count(distinct lower(t)) concepts
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) t from documents)
    where lower(t) not in ({stopwords}) and (length(t) >= 3 or (length(t) >= 2 and upper(t) = t)) group by 1""".replace(
        "{stopwords}", _FILL["stopwords"]
    ),
)
_check("auto_concepts", "word_box term", "select * from term")
_check("concept_hits", _HITS, "select doc_id, page_no, word_no, concept from hit")
_check("page_hits", _HITS + " page_hit", "select * from page_hit")
_check(
    "document_hits",
    _HITS,
    """select doc_id, count(concept) n_hits, count(*) n_words, count(concept) < 8 fallback
    from clean left join vocab using (c) where c <> '' group by all""",
)


def _resolved(pages: str) -> str:
    return f"""
    select doc_id, page_no, false fallback, count(*) n_hits from hit
    where {pages} and doc_id not in (select doc_id from poor) group by all
    union all
    select doc_id, page_no, true, count(*) from (
      select distinct clean.doc_id, page_no, word_no from clean join term using (doc_id)
      where {pages} and c <> '' and doc_id in (select doc_id from poor) and (c = concept
        or (length(c) >= 4 and length(concept) >= 4 and (starts_with(c, concept) or starts_with(concept, c))))) group by all"""


def _poor(pages: str) -> str:
    return f"""poor as (select doc_id from clean left join vocab using (c) where c <> '' and {pages}
      group by doc_id having count(concept) < 8) """


for _name, _pages in (("resolved_page_hits", "true"), ("resolved_page_hits_first_page", "page_no <= 1")):
    _check(_name, _HITS + " term", "")
    _checks[_name] = _checks[_name].rstrip() + ", " + _poor(_pages) + _resolved(_pages)
_check("concepts_used", _HITS + " term", "")
_checks["concepts_used"] = (
    _checks["concepts_used"].rstrip()
    + f""", {_poor("true")} select doc_id, doc_id in (select doc_id from poor) fallback,
      case when doc_id in (select doc_id from poor) then coalesce(own, '') else '{" ".join(CONCEPTS)}' end concepts
    from (select distinct doc_id from clean)
    left join (select doc_id, string_agg(concept, ' ' order by ord) own from term group by all) using (doc_id)"""
)
_check("concepts_used_first_page", _HITS + " term", "")
_checks["concepts_used_first_page"] = (
    _checks["concepts_used_first_page"].rstrip()
    + f""" select doc_id, n_hits, n_hits < 8 fallback,
      case when n_hits < 8 then coalesce(own, '') else '{" ".join(CONCEPTS)}' end concepts
    from (select doc_id, count(concept) filter (page_no <= 1) n_hits from clean left join vocab using (c) group by doc_id)
    left join (select doc_id, string_agg(concept, ' ' order by ord) own from term group by all) using (doc_id)"""
)
_check(
    "auto_page_hits",
    "word_box clean term",
    """select doc_id, page_no, count(*) n_hits from (
      select distinct clean.doc_id, page_no, word_no from clean join term using (doc_id) where c <> '' and (c = concept
        or (length(c) >= 4 and length(concept) >= 4 and (starts_with(c, concept) or starts_with(concept, c))))) group by all""",
)
_PAGE_ORDER = "order by n_hits desc, doc_id, page_no"
_check(
    "page_ranking",
    _HITS + " page_hit",
    "select *, row_number() over (partition by doc_id order by n_hits desc, page_no) rank from page_hit",
)
_check(
    "strongest_pages",
    _HITS + " page_hit",
    "select * from page_hit qualify row_number() over (partition by doc_id order by n_hits desc, page_no) = 1",
)
_check("top_pages", _HITS + " page_hit", f"select * from page_hit {_PAGE_ORDER} limit 10")
_check(
    "top_pages_per_doc",
    _HITS + " page_hit",
    """select *, (row_number() over (partition by doc_id order by n_hits desc, page_no))::int rank from page_hit
    qualify rank <= 3""",
)
_check(
    "literature_manifest",
    _HITS + " page_hit",
    f"""select *, printf('page_%02d_heatmap.png', page_no) file from (
      select 'pages' section, *, row_number() over (partition by doc_id order by n_hits desc, page_no) rank from page_hit
      union all select 'strongest', *, row_number() over ({_PAGE_ORDER}) from page_hit qualify row_number() over ({_PAGE_ORDER}) <= 10)""",
)
_SPLAT = _HITS + " splat"
_BLUR = _SPLAT + " kernel rows_blurred blurred"
_check("heat_splat", _SPLAT, "select doc_id, page_no, y, x, floor(w * 1e6 + 0.5)::bigint w from splat")
_check(
    "heat_page_totals",
    _SPLAT + " page_hit",
    """select doc_id, page_no, case when peak > 0 then n_hits else 0 end n_hits from page_hit
    left join (select doc_id, page_no, max(w) peak from splat group by all) using (doc_id, page_no)""",
)
_check(
    "heat_blur",
    _BLUR,
    """select doc_id, page_no, count(*) pixels, sum(floor(w * 1e6 + 0.5)::bigint)::bigint heat,
      floor(max(w) * 1e6 + 0.5)::bigint peak from blurred group by all""",
)
_check(
    "heat_alpha",
    _BLUR + " toned",
    """select doc_id, page_no, count(*) filter (alpha > 0) visible, sum(floor(alpha * 1e4 + 0.5)::bigint)::bigint alpha
    from toned group by all""",
)
_check(
    "heat_colour",
    _BLUR + " toned coloured",
    "select doc_id, page_no, "
    + ", ".join(f"sum(floor({c} * 100 + 0.5)::bigint)::bigint {c}" for c in "rgb")
    + " from coloured where alpha > 0 group by all",
)
_check(
    "heat_conserved", _SPLAT, "select doc_id, page_no, floor(sum(w) * 1000 + 0.5)::bigint heat from splat group by all"
)
# A page is white but for its dots and what the heat changes.
_check(
    "heat_composite",
    _BLUR + " toned coloured dot",
    """select doc_id, page_no, 1254 * 1584::bigint pixels, """
    + ", ".join(f"(1254 * 1584 * 255 + coalesce(dark, 0) + coalesce({c}, 0))::bigint {c}" for c in "rgb")
    + """ from (select distinct doc_id, page_no from word_box)
    left join (select doc_id, page_no, sum(gray - 255) dark from dot group by all) using (doc_id, page_no)
    left join (select doc_id, page_no, """
    + ", ".join(f"sum(trunc(least(255, base * (1 - alpha) + {c} * alpha)) - base) {c}" for c in "rgb")
    + """ from (select c.*, coalesce(gray, 255)::double base from coloured c left join dot using (doc_id, page_no, y, x)
        where alpha > 0) group by all) using (doc_id, page_no)""",
)
_check(
    "log_strings",
    "",
    """select conv_id, turn, n::int str_no, t "text" from (
      select conv_id, turn, unnest([0, 1, 2]) n, unnest([role, text, concat('say "', role, '"\\end')]) t from conversations)""",
)
_check(
    "log_property_strings",
    "",
    """select event_id, unnest([0, 1])::int str_no, unnest([event_type, concat('u', user_id)]) "text" from events""",
)
_check("log_call_arguments", "log_item", """select * from log_item where "text" <> ''""")
_check("log_keywords", "log_item keyword", 'select kind, conv_id, turn, "text" from keyword')
_check("log_keyword_counts", "log_item keyword", "select kind, count(*) keywords from keyword group by all")
_check(
    "file_log",
    "log_item log_line",
    """select kind, part, line_num, "text" from (select * from log_item where "text" <> '') join log_line using (conv_id, turn)
    qualify row_number() over (partition by kind, "text" order by part, line_num, call_no, item_no) = 1""",
)
_check(
    "blob_filter",
    "",
    r"""select conv_id, turn, form, length(t)::int n_chars from (
      select conv_id, turn, form, regexp_replace(t, '^\s+|\s+$', '', 'g') t from (
        select conv_id, turn, 'text' form, text t from conversations
        union all select conv_id, turn, 'joined', regexp_replace(text, '[^A-Za-z0-9]', '', 'g') from conversations
        union all select conv_id, turn, 'dense', regexp_replace(text, '\s', '-', 'g') from conversations
        union all select conv_id, turn, 'short', concat('  ', role, chr(10)) from conversations))
    where length(t) >= 20 and not starts_with(t, 'gAAAAA') and not (length(t) > 120 and not contains(t, ' ')
      and length(regexp_replace(t, '[A-Za-z0-9_=-]', '', 'g')) / length(t) < 0.05)""",
)
_SHAPE = "volume solid touch part"
_check(
    "mask_parts",
    _SHAPE,
    """select volume_id, (root >> 42)::int z, ((root >> 21) & 2097151)::int y, (root & 2097151)::int x, count(*) voxels
    from part group by volume_id, root""",
    solid=0.18,
)
_check(
    "mask_topology",
    f"{_SHAPE} cell euler",
    """select volume_id, count(*) voxels, count(distinct root) parts, any_value(euler_number) euler_number
    from part join euler using (volume_id) group by all""",
    solid=0.05,
)
_check(
    "skeleton_topology",
    f"{_SHAPE} cell euler",
    """select volume_id, count(distinct root) parts, any_value(euler_number) euler_number, 0::bigint outside, true thinner
    from part join euler using (volume_id) group by all""",
    solid=0.05,
)
_check(
    "file_volume",
    "stack",
    "select z, count(*) voxels, sum(floor(v::double * (x + 1) * 1e6 + 0.5)::bigint)::bigint total from stack group by all",
)
_check("file_plane", "stack", "select z, y, x, v::double v from stack where z = (select count(*) from embeddings) // 2")
_check(
    "file_segment",
    "stack",
    """select z, count(*) filter (v >= 0.05::float) foreground,
      (select count(*) from stack where v >= 0.05::float) reported from stack group by all""",
)
_check(
    "file_slice",
    "stack",
    """select z "row", x col, floor((v::double - low) / (high - low) * 255)::int gray
    from stack, (select min(v)::double low, max(v)::double high from stack where y = 3) where y = 3""",
)
_check(
    "file_skeleton",
    "stack solid touch part cell euler",
    """select (select count(*) from embeddings)::int nz, 8 ny, 8 nx, 'bool' dtype, count(distinct root) parts,
      any_value(euler_number) euler_number, 0::bigint outside from part join euler using (volume_id)""",
    voxels="stack",
    solid="0.05::float",
)
_check(
    "file_tiff", "volume", "select volume_id, z, count(*) voxels, sum(g * (y + 1))::bigint total from volume group by all"
)
_check(
    "file_meshes",
    "triangle",
    """select mesh_id, count(*) triangles, count(*) - 1 "last", count(*) named, sum("""
    + " + ".join(f"{k} * {v}{axis}" for k, (v, axis) in enumerate(((v, a) for v in "abc" for a in "xyz"), 1)).replace("by", '"by"')
    + """)::bigint total from triangle group by all""",
)
_check(
    "file_tree",
    "files",
    """select path, octet_length(encode(text))::bigint length, content_md5
    from files join documents on regexp_extract(path, 'doc_([0-9]+)', 1)::bigint = doc_id""",
)
_check("file_top_folders", "", 'select distinct source folder from documents')
_GRAPH = "volume solid touch voxel named item branch_step branch_end"
_check(
    "mask_nodes",
    _GRAPH,
    """select volume_id, root node, kind, count(*) voxels from item join voxel using (volume_id, p) where kind <> 'link'
    group by all""",
    solid=0.18,
)
_check(
    "mask_branches",
    _GRAPH,
    """select s.*, e."start", e."end", coalesce(l.links, 0) links from (
      select volume_id, branch, count(*) filter (d = 1) steps_1, count(*) filter (d = 2) steps_2, count(*) filter (d = 3) steps_3
      from branch_step group by all) s
    left join (select volume_id, branch, min(node) "start", max(node) "end" from branch_end group by all) e using (volume_id, branch)
    left join (select volume_id, root branch, count(*) links from item join voxel using (volume_id, p) where kind = 'link'
      group by all) l using (volume_id, branch)""",
    solid=0.18,
)
_check(
    "skeleton_branches",
    _SHAPE,
    """select volume_id, count(distinct root) parts, 0::bigint unplaced_voxels, 0::bigint loose_ends, 0::bigint half_branches
    from part group by all""",
    solid=0.05,
)
_check("mask_degree", "volume mask degree kinds", "select * from kinds")


def _tidy(section: str, item: str, source: str, **metrics: str) -> str:
    return " union all ".join(
        f"select '{section}' section, {item} item, '{name}' metric, ({value})::double \"value\" from {source}"
        for name, value in metrics.items()
    )


def _columns(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_check(
    "inventory_report",
    "volume files profile triangle extent graph_doc graph_doc_profile first_volume_copy",
    " union all ".join(
        [
            _tidy(
                "totals",
                "'all'",
                "files",
                files="count(*)",
                json_files="count(*) filter (ext = '.json')",
                stl_files="count(*) filter (ext = '.stl')",
                volume_files="count(*) filter (ext in ('.tif', '.npy'))",
            ),
            _tidy("totals", "'all'", "files", folders="count(distinct folder)"),
            _tidy("extensions", "case ext when '' then '(no ext)' else ext end", "files", files="count(*)") + " group by 2",
            _tidy("folders", "folder", "files", files="count(*)") + " group by 2",
            _tidy(
                "volumes",
                "case when path <> first_path then 'duplicate' else 'first' end",
                "files join first_volume_copy using (content_md5) where ext in ('.tif', '.npy')",
                volumes="count(*)",
            )
            + " group by 2",
            _tidy(
                "graphs",
                "graph_no::varchar",
                "graph_doc_profile",
                **_columns("junctions", "struts", "unit_cells", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z"),
            ),
            _tidy("meshes", "mesh_id", "extent", n_triangles="n_triangles"),
            _tidy("volume_stats", "volume_id", "profile", **_columns("nz", "ny", "nx", "min_v", "max_v", "mean_v")),
        ]
    ),
)
_check(
    "nde_report",
    "volume mask solid touch part cell euler truth profile agreement sweep strut coverage",
    " union all ".join(
        [
            _tidy(
                "metadata", "volume_id", "profile", **_columns("nz", "ny", "nx", "n_voxels", "min_v", "max_v", "mean_v")
            ),
            _tidy("sweep", "concat(volume_id, '/', printf('%.2f', threshold))", "sweep", foreground_voxels="foreground_voxels"),
            _tidy(
                "segmentation",
                "volume_id",
                f"(select volume_id, {_STATS} from mask group by all)",
                **_columns("foreground_voxels", "background_voxels"),
            ),
            _tidy(
                "ground_truth",
                "volume_id",
                "agreement",
                true_positives="tp",
                false_positives="fp",
                false_negatives="fn",
                iou="tp / (tp + fp + fn)",
                dice="2 * tp / (2 * tp + fp + fn)",
            ),
            _tidy(
                "struts",
                "graph_id",
                """(select graph_id, count(*) struts, count(*) filter (missing) missing, count(*) filter (broken) broken,
                  count(*) filter (missing) * 100.0::double / count(*) missing_percent from coverage group by all)""",
                **_columns("struts", "missing", "broken", "missing_percent"),
            ),
            _tidy(
                "connectivity",
                "volume_id",
                """(select volume_id, count(distinct root) parts, any_value(euler_number) euler_number
                  from part join euler using (volume_id) group by all)""",
                parts="parts",
                euler_number="euler_number",
                outside="0",
                graph_parts="parts",
                unplaced_voxels="0",
                loose_ends="0",
            ),
        ]
    ),
    solid=0.05,
)
