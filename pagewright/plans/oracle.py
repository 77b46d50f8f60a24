"""DuckDB SQL for the queries, written apart from the operators: recursive or windowed where those fold or join."""

from __future__ import annotations

DET = """
raw as (select event_id as k, cast(round(value*100) as bigint) as v from events),
d0 as (select k, v, k//120 as doc_id, (k%120)//12+1 as page_number, k%12 as det_idx, (k*31+v)%100 as c, (k*17+v)%3 as lane, (k*13+v*7)%8 as h1, (k*11+v*3)%6 as h2, (k*7+v*5)%10 as h3 from raw),
d1 as (select *, case when c<28 then 'Figure' when c<58 then 'Figure-Caption' when c<72 then 'Table' when c<90 then 'Table-Caption' when c<96 then 'Plain-Text' else 'Title' end as class_name, 80+180*lane+10*h2 as bx, 100+55*det_idx+5*h1 as byy from d0),
det as (select k as event_id, doc_id, page_number, det_idx, class_name, cast(0.25 as double) + cast(v%7500 as double)/10000 as confidence, cast(bx as double) as x1, cast(byy as double) as y1,
  cast(bx+200+40*h3 as double) as x2, cast(case when class_name in ('Figure','Table') then byy+50+10*h2 else byy+20+5*h2 end as double) as y2 from d1),
pages_ as (select doc_id, unnest(range(1, 11)) as page_number from (select distinct doc_id from det))"""

ITEMS = (
    DET
    + """,
items as (select doc_id, page_number, case class_name when 'Figure' then 'figure' else 'table' end as kind, det_idx as item_idx, x1, y1, x2, y2 from det where class_name in ('Figure','Table')),
caps as (select doc_id, page_number, case class_name when 'Figure-Caption' then 'figure' else 'table' end as kind, det_idx as cap_idx, x1 as cx1, y1 as cy1, x2 as cx2, y2 as cy2 from det where class_name in ('Figure-Caption','Table-Caption')),
geo as (select *, case when least(x2-x1, cx2-cx1) > 0 then greatest(least(x2,cx2)-greatest(x1,cx1), 0.0)/least(x2-x1, cx2-cx1) else 0.0 end as overlap,
  case when cy1-y2 >= 0 then cy1-y2 end as below, case when y1-cy2 >= 0 then y1-cy2 end as above from items join caps using (doc_id, page_number, kind)),
geob as (select *, coalesce(below, above, 0.0) as both_ from geo)"""
)


def greedy(distance: str) -> str:
    """Rank a page's pairs and step through them with two lists of what is taken."""
    return (
        ITEMS
        + f""",
cand as (select doc_id, page_number, kind, item_idx, cap_idx, {distance} as dist, overlap from geob where {distance} <= 100 and overlap >= 0.3),
ranked as (select *, row_number() over (partition by doc_id, page_number, kind order by dist, item_idx, cap_idx) as r from cand),
walk as (
  select doc_id, page_number, kind, r, item_idx, cap_idx, dist, true as ok, [item_idx] as ui, [cap_idx] as uc from ranked where r = 1
  union all
  select n.doc_id, n.page_number, n.kind, n.r, n.item_idx, n.cap_idx, n.dist, not (list_contains(w.ui, n.item_idx) or list_contains(w.uc, n.cap_idx)),
    case when list_contains(w.ui, n.item_idx) or list_contains(w.uc, n.cap_idx) then w.ui else list_append(w.ui, n.item_idx) end,
    case when list_contains(w.ui, n.item_idx) or list_contains(w.uc, n.cap_idx) then w.uc else list_append(w.uc, n.cap_idx) end
  from walk w join ranked n on n.doc_id = w.doc_id and n.page_number = w.page_number and n.kind = w.kind and n.r = w.r + 1),
taken as (select doc_id, page_number, kind, item_idx, cap_idx, dist from walk where ok)"""
    )


DEFAULT = "(case when kind = 'table' then above else below end)"
GREEDY = greedy(DEFAULT)
MATCH = (
    GREEDY
    + """,
m as (select i.*, t.cap_idx, t.dist, c.cx1, c.cy1, c.cx2, c.cy2 from items i left join taken t using (doc_id, page_number, kind, item_idx)
  left join caps c on c.doc_id = i.doc_id and c.page_number = i.page_number and c.kind = i.kind and c.cap_idx = t.cap_idx)"""
)
IOU = "case when least({a}x2,{b}x2)-greatest({a}x1,{b}x1) > 0 and least({a}y2,{b}y2)-greatest({a}y1,{b}y1) > 0 then (least({a}x2,{b}x2)-greatest({a}x1,{b}x1))*(least({a}y2,{b}y2)-greatest({a}y1,{b}y1)) / (({a}x2-{a}x1)*({a}y2-{a}y1)+({b}x2-{b}x1)*({b}y2-{b}y1)-(least({a}x2,{b}x2)-greatest({a}x1,{b}x1))*(least({a}y2,{b}y2)-greatest({a}y1,{b}y1))) else 0.0 end"
TRUTH = (
    MATCH
    + """,
t0 as (select *, doc_id*120+(page_number-1)*12+item_idx as k from m),
t1 as (select *, (k*29+7)%20 as g, cast((k*37)%50+50 as double)/100.0 as confidence, cast(6*((k*5)%4) as double) as dx, cast(5*((k*3)%3) as double) as dy from t0),
t2 as (select *, (g < 2 or (cap_idx is null and g >= 6)) as bare, case when g < 4 then 300.0 else dx end as sh from t1),
truth as (select doc_id, page_number, kind, k as gt_ord, confidence, x1+dx as x1, y1+dy as y1, x2+dx as x2, y2+dy as y2,
  case when bare then null when cap_idx is null then x1 else cx1+sh end as gx1, case when bare then null when cap_idx is null then y2+10.0 else cy1 end as gy1,
  case when bare then null when cap_idx is null then x2 else cx2+sh end as gx2, case when bare then null when cap_idx is null then y2+40.0 else cy2 end as gy2,
  'gt_' || k as figure_id, case when bare then null else 'cap_' || k end as caption_id from t2)"""
)
BEST = (
    TRUTH
    + f""",
pred as (select doc_id, page_number, case kind when 'figure' then 0 else 1000000000 end + page_number*100 + item_idx as pred_ord, x1 as px1, y1 as py1, x2 as px2, y2 as py2, cx1 as pcx1, cy1 as pcy1, cx2 as pcx2, cy2 as pcy2 from m),
met as (select t.*, p.pred_ord, p.pcx1, p.pcy1, p.pcx2, p.pcy2, coalesce({IOU.format(a="t.", b="p.p")}, 0.0) as item_iou from truth t left join pred p using (doc_id, page_number) where confidence >= 0.7),
best as (select *, item_iou >= 0.5 as found from met qualify row_number() over (partition by gt_ord order by item_iou desc, pred_ord) = 1),
cmp0 as (select *, gx1 is not null as has_gt, (found and pcx1 is not null) as has_pred, coalesce({IOU.format(a="g", b="pc")}, 0.0) as ci from best),
cmp as (select *, case when not has_gt and not has_pred then 1.0 when has_gt and has_pred then ci else 0.0 end as caption_iou,
  case when not has_gt and not has_pred then true when has_gt and has_pred then ci >= 0.5 else false end as is_correct from cmp0),
comp as (select *, case when is_correct then null when not has_gt then 'false_positive' when not has_pred then 'false_negative' else 'wrong_match' end as error_type from cmp)"""
)
PRF = "case when tp+fp > 0 then tp::double/(tp+fp) else 0.0 end as precision, case when tp+fn > 0 then tp::double/(tp+fn) else 0.0 end as recall, case when tp = 0 then 0.0 else 2.0*(tp::double/(tp+fp))*(tp::double/(tp+fn))/((tp::double/(tp+fp))+(tp::double/(tp+fn))) end as f1"
COUNTS = "count(*) as total, count(*) filter (is_correct and has_gt) as tp, count(*) filter (is_correct and not has_gt) as correct_no_caption, count(*) filter (error_type in ('false_positive','wrong_match')) as fp, count(*) filter (error_type in ('false_negative','wrong_match')) as fn"
KIND = "count(*) as total, count(*) filter (is_correct and caption_id is not null) as tp, count(*) filter (error_type = 'false_positive') as fp, count(*) filter (error_type = 'false_negative') as fn, count(*) filter (is_correct) as correct"
ELEMENTS = """,
el0 as (select *, case class_name when 'Figure' then 'figure' when 'Table' then 'table' else 'caption' end as kind from det where class_name in ('Figure','Table','Figure-Caption','Table-Caption')),
el as (select *, row_number() over (partition by doc_id, page_number, kind order by det_idx) as no,
  case when kind = 'caption' then case det_idx % 4 when 0 then '' when 1 then repeat('caption ', 9) else 'Caption ' || det_idx end end as txt from el0),
eli as (select *, case kind when 'figure' then 'fig' when 'table' then 'table' else 'cap' end || printf('_%02d_%02d', page_number, no) as item_id from el)"""
ANSWERS = """,
ans as (select doc_id, page_number, (doc_id+page_number)%4 <> 3 as ok, page_number%3 as c1, doc_id%3+1 as f2 from pages_),
am0 as (select doc_id, page_number, 0 as ord, 1 as figure_no, 'figure' as kind, c1 as caption_no, 0.5 as confidence from ans where ok union all select doc_id, page_number, 1, f2, 'table', 9, 1.0 from ans where ok),
am as (select a.*, e.x1, e.y1, e.x2, e.y2, c.x1 as cx1, c.y1 as cy1, c.x2 as cx2, c.y2 as cy2, c.txt as caption_text,
  case a.kind when 'figure' then 'fig' else 'table' end || printf('_%02d_%02d', a.page_number, a.figure_no) as figure_id, case when caption_no <> 0 then printf('cap_%02d_%02d', a.page_number, a.caption_no) end as caption_id
  from am0 a join eli e on e.doc_id = a.doc_id and e.page_number = a.page_number and e.kind = a.kind and e.no = a.figure_no
  left join eli c on c.doc_id = a.doc_id and c.page_number = a.page_number and c.kind = 'caption' and c.no = a.caption_no),
used as (select doc_id, page_number, kind, figure_no as no from am union select doc_id, page_number, 'caption', caption_no from am where cx1 is not null),
loose as (select doc_id, page_number, kind, no from eli where not exists (select 1 from used u where u.doc_id = eli.doc_id and u.page_number = eli.page_number and u.kind = eli.kind and u.no = eli.no)
  union select doc_id, page_number, 'caption', 2 from ans where ok),
loosei as (select *, case kind when 'figure' then 'fig' when 'table' then 'table' else 'cap' end || printf('_%02d_%02d', page_number, no) as item_id from loose)"""
REGIONS = """,
sh as (select doc_id, page_number, 0 as part, ord as o, 0 as sub, figure_id as item_id, case kind when 'table' then 'Table' else 'Figure' end as label, x1, y1, x2, y2 from am
  union all select doc_id, page_number, 0, ord, 1, caption_id, 'Caption', cx1, cy1, cx2, cy2 from am where caption_id is not null and cx1 is not null),
rs as (select l.doc_id, l.page_number, case l.kind when 'figure' then 1 when 'table' then 2 else 3 end as part, l.no as o, 0 as sub, l.item_id, upper(l.kind[1]) || l.kind[2:] as label, e.x1, e.y1, e.x2, e.y2
  from loosei l join eli e on e.doc_id = l.doc_id and e.page_number = l.page_number and e.kind = l.kind and e.no = l.no
  where not exists (select 1 from sh where sh.doc_id = l.doc_id and sh.page_number = l.page_number and sh.item_id = l.item_id)),
reg as (select *, 'region_' || row_number() over (partition by doc_id, page_number order by part, o, sub) as region_id from (select * from sh union all select * from rs))"""
FILES = "files as (select doc_id, 'doc' || doc_id as name from documents)"
MANIFEST = (
    FILES
    + """,
man as (select doc_id, name, 'annotations/' || name || '.json' as annotation_path, case when doc_id % 7 <> 0 then 'extractions/' || name || '.json' end as extraction_path from files)"""
)
RUNS = "runs as (select distinct 'run' || n_regionkey as label, 'key' || (n_nationkey % 7) as key, 'run' || n_regionkey || '/key' || (n_nationkey % 7) as value from nation)"


def q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes.strip()}\n{select}"


P = "doc_id, page_number"
SQL: dict[str, str] = {
    "detections_scan": q(DET, "select * from det"),
    "filter_by_class": q(DET, "select event_id, class_name from det where class_name in ('Figure','Table')"),
    "confidence_filter": q(DET, "select event_id, confidence from det where confidence >= 0.5"),
    "page_expansion": q(DET, "select * from pages_"),
    "page_class_stats": q(DET, f"select {P}, class_name, count(*) as n from det group by all"),
    "page_counts": q(DET, f"select p.doc_id, p.page_number, count(d.event_id) as n from pages_ p left join det d on p.doc_id = d.doc_id and p.page_number = d.page_number and d.class_name = 'Title' group by all"),
    "doc_class_stats": q(DET, "select doc_id, class_name, count(*) as n, sum(cast(round(confidence*10000) as bigint))::double/count(*)/10000.0 as average_confidence from det group by all"),
    "avg_confidence_by_class": q(DET, "select class_name, sum(cast(round(confidence*10000) as bigint))::double/count(*)/10000.0 as average_confidence from det group by all"),
    "document_summary": q(DET, "select doc_id, 10::bigint as total_pages, count(*) as total_detections, count(*)::double/10 as average_detections_per_page from det group by doc_id"),
    "summary_report": q(DET, "select count(distinct doc_id) as total_documents, (count(distinct doc_id)*10)::bigint as total_pages, count(*) as total_detections, count(*)::double/(count(distinct doc_id)*10) as average_detections_per_page from det"),
    "class_ranking": q(DET, "select class_name, count(*) as n, row_number() over (order by count(*) desc, min(event_id)) as rank from det group by class_name"),
    "stats_rollup": q(DET, "select coalesce(doc_id, -1) as doc_id, class_name, n from (select doc_id, class_name, count(*) as n from det group by rollup(doc_id, class_name))"),
    "pixel_to_pdf": q(DET, "select event_id, x1*72.0::double/200 as x1, y1*72.0::double/200 as y1, x2*72.0::double/200 as x2, y2*72.0::double/200 as y2 from det"),
    "crop_rect": q(DET, "select event_id, greatest(0.0::double, x1*72.0::double/200-3.6::double) as x1, greatest(0.0::double, y1*72.0::double/200-3.6::double) as y1, least(300.0::double, x2*72.0::double/200+3.6::double) as x2, least(250.0::double, y2*72.0::double/200+3.6::double) as y2 from det"),
    "normalize_to_pixel": q(DET, "select event_id, trunc(x1*1654/1000.0::double)::bigint as x1, trunc(y1*2339/1000.0::double)::bigint as y1, trunc(x2*1654/1000.0::double)::bigint as x2, trunc(y2*2339/1000.0::double)::bigint as y2 from det"),
    "bbox_percent": q(DET, "select event_id, x1/1654.0::double*100.0::double as x, y1/2339.0::double*100.0::double as y, (x2-x1)/1654.0::double*100.0::double as width, (y2-y1)/2339.0::double*100.0::double as height from det"),
    "pair_geometry": q(ITEMS, f"select {P}, kind, item_idx, cap_idx, overlap, below, above, both_ as \"both\" from geob"),
    "caption_candidates": q(GREEDY, "select * from cand", True),
    "caption_match_greedy": q(GREEDY, "select * from taken", True),
    "match_left_outer": q(MATCH, f"select {P}, kind, item_idx, coalesce(cap_idx, -1) as cap_idx, dist, cx1 from m", True),
    "match_both_directions": q(greedy("both_"), "select * from taken", True),
    "unmatched_items": q(MATCH, f"select {P}, kind, item_idx from m where cap_idx is null", True),
    "unmatched_captions": q(GREEDY, f"select {P}, kind, cap_idx from caps anti join taken using (doc_id, page_number, kind, cap_idx)", True),
    "suppressed_boxes": q(
        DET
        + f""",
ro as (select *, row_number() over (partition by doc_id, page_number, class_name order by confidence desc, det_idx) as r from det),
wk as (
  select doc_id, page_number, class_name, r, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as kept, true as ok, det_idx from ro where r = 1
  union all
  select n.doc_id, n.page_number, n.class_name, n.r, case when len(list_filter(w.kept, lambda b: {IOU.format(a="b.", b="n.")} > 0.2)) > 0 then w.kept else list_append(w.kept, {{'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) end,
    len(list_filter(w.kept, lambda b: {IOU.format(a="b.", b="n.")} > 0.2)) = 0, n.det_idx
  from wk w join ro n on n.doc_id = w.doc_id and n.page_number = w.page_number and n.class_name = w.class_name and n.r = w.r + 1)""",
        f"select {P}, class_name, det_idx from wk where ok",
        True,
    ),
    "item_numbering_doc": q(ITEMS, f"select {P}, kind, item_idx, case kind when 'figure' then 'fig' else 'table' end || printf('_%02d_%02d', page_number, row_number() over (partition by doc_id, kind order by page_number, item_idx)) as item_id from items"),
    "item_numbering_page": q(DET + ELEMENTS, f"select {P}, det_idx, item_id from eli"),
    "extraction_stats": q(MATCH, "select doc_id, count(*) filter (kind = 'figure') as total_figures, count(*) filter (kind = 'figure' and cap_idx % 3 <> 0) as figures_with_captions, count(*) filter (kind = 'table') as total_tables, count(*) filter (kind = 'table' and cap_idx % 3 <> 0) as tables_with_captions from m group by doc_id", True),
    "item_texts": q(
        ITEMS
        + """,
num as (select *, case kind when 'figure' then 'fig' else 'table' end || printf('_%02d_%02d', page_number, row_number() over (partition by doc_id, kind order by page_number, item_idx)) as item_id from items)""",
        "select n.doc_id, n.page_number, n.item_id, string_agg('w' || t.det_idx, ' ' order by t.det_idx) as item_text from num n join det t on t.doc_id = n.doc_id and t.page_number = n.page_number and t.class_name = 'Title' and (t.x1+t.x2)/2 between n.x1 and n.x2 and (t.y1+t.y2)/2 between n.y1 and n.y2 group by all",
    ),
    "high_confidence": q(TRUTH, "select figure_id, confidence from truth where confidence >= 0.8", True),
    "caption_map": q(TRUTH, "select doc_id, kind || page_number as figure_id, arg_max(caption_id, gt_ord) as caption_id from truth where caption_id is not null group by all", True),
    "dataset_statistics": q(TRUTH, "select doc_id, count(*) as total_matches, count(*) filter (kind = 'figure' and caption_id <> '') as figures_with_captions, count(*) filter (kind = 'table' and caption_id <> '') as tables_with_captions from truth group by doc_id", True),
    "merged_datasets": q(TRUTH, "select kind, figure_id, confidence, 'merged' as pdf_name from truth where kind = 'figure' union all select kind, figure_id, confidence, 'merged' from truth where confidence >= 0.9", True),
    "iou_best_match": q(BEST, "select figure_id, pred_ord, item_iou, found from best", True),
    "match_comparison": q(BEST, "select figure_id, kind, page_number, is_correct, error_type, item_iou, caption_iou from comp", True),
    "eval_by_doc": q(BEST, f"select *, {PRF} from (select doc_id, {COUNTS} from comp group by doc_id)", True),
    "eval_overall": q(BEST, f"select *, {PRF} from (select {COUNTS} from comp)", True),
    "eval_by_kind": q(BEST, f"select *, {PRF}, correct::double/total as accuracy from (select kind, {KIND} from comp group by kind)", True),
    "batch_kind_strict": q(BEST, f"select *, {PRF} from (select kind, sum(floor(total*acc))::bigint as tp, 0::bigint as fp, sum(floor(total*(1.0-acc)))::bigint as fn from (select kind, total, floor(correct::double/total*10000.0+0.5)/10000.0::double as acc from (select doc_id, kind, {KIND} from comp group by all)) group by kind)", True),
    "batch_kind_corrected": q(BEST, f"select *, {PRF} from (select kind, count(*) filter (is_correct and caption_id is not null) as tp, count(*) filter (error_type = 'false_positive') as fp, count(*) filter (error_type = 'false_negative') as fn from comp group by kind)", True),
    "error_histogram": q(BEST, "select error_type, count(*) as n from comp where not is_correct group by all", True),
    "errors_by_page": q(BEST, f"select {P}, figure_id, error_type, case when has_pred then 'matched (IoU-based)' end as predicted, caption_id as expected from comp where not is_correct", True),
    "manifest_validate": q(MANIFEST, "select name, doc_id % 5 <> 0 as valid, extraction_path is not null and doc_id % 3 <> 0 as missing_extraction from man"),
    "predictions_resolve": q(MANIFEST, "select name, case when extraction_path is not null and doc_id % 3 = 0 then 'bench/' || extraction_path when doc_id % 4 = 0 then 'out/' || name || '/extractions/extraction_metadata.json' when doc_id % 2 = 0 then 'out/' || name || '/result.json' end as resolved from man"),
    "manifest_build": q(FILES, "select name, 'annotations/' || name || '.json' as annotation_path, case when doc_id % 3 = 0 then 'extractions/' || name || '.json' end as extraction_path, 'benchmark' as dataset, '1.0' as version, 'model' || (select min(doc_id) from files where doc_id % 5 <> 0 and doc_id >= 4) as annotator from files where doc_id % 5 <> 0"),
    "annotate_discovery": q(FILES, "select * from files where doc_id % 2 = 0 and doc_id % 3 <> 0"),
    "export_discovery": q(FILES, "select * from files where doc_id % 3 = 0"),
    "page_image_resolve": q(
        DET
        + """,
pg as (select doc_id, page_number, 'p' || doc_id as dir, (doc_id+page_number)%5 as form from pages_),
im as (select dir, page_number, dir || '/' || case form when 0 then printf('page_%04d.png', page_number) when 1 then printf('page_%03d.png', page_number) when 2 then printf('page_%d.png', page_number) else printf('scan%dx.png', page_number) end as path from pg where form < 4)""",
        "select pg.doc_id, pg.page_number, pg.dir, case when form < 3 then (select path from im where im.dir = pg.dir and im.page_number = pg.page_number) else (select min(path) from im where im.dir = pg.dir and contains(split_part(path, '/', 2), pg.page_number::varchar)) end as image_path from pg",
    ),
    "vlm_json_repair": q(DET + ANSWERS.split("am0 as")[0].rstrip().rstrip(","), f"select {P}, ok as success, case when not ok then 'Failed to parse VLM response as JSON' end as error, case when ok then 3 else 0 end::bigint as n_matches, case when ok then 2 else -1 end::bigint as first_unmatched from ans"),
    "vlm_matches": q(DET + ELEMENTS + ANSWERS, f"select {P}, kind, figure_id, caption_id, confidence::double as confidence, x1, cx1, caption_text from am"),
    "vlm_unmatched": q(DET + ELEMENTS + ANSWERS, f"select {P}, item_id from loosei"),
    "annotation_counts": q(DET + ELEMENTS + ANSWERS, "select doc_id, count(*) as total_figures, count(*) filter (kind = 'table') as total_tables, count(caption_id) as total_with_captions, count(distinct page_number) as pages_with_matches from am group by doc_id"),
    "pages_without_items": q(DET + ELEMENTS, f"select {P} from pages_ p where not exists (select 1 from eli e where e.doc_id = p.doc_id and e.page_number = p.page_number and kind <> 'caption')"),
    "prompt_elements": q(
        DET
        + ELEMENTS
        + """,
ln as (select doc_id, page_number, case kind when 'figure' then 0 when 'table' then 1 else 2 end as r, no, case when kind = 'caption' then '  - C' || no || ': "' || case when length(txt) > 50 then txt[:50] || '...' when txt = '' then '[no text]' else txt end || '" at ' else '  - ' || case kind when 'figure' then 'F' else 'T' end || no || ': at position ' end
  || '(' || x1::bigint || ', ' || y1::bigint || ')' as line from eli),
hd as (select distinct doc_id, page_number, r, 0 as no, case r when 0 then 'FIGURES (green boxes):' when 1 then 'TABLES (blue boxes):' else 'CAPTIONS (orange boxes):' end as line from ln),
al as (select * from ln union all select * from hd),
ds as (select doc_id, page_number, string_agg(line, chr(10) order by r, no) as description from al group by all)""",
        "select p.doc_id, p.page_number, coalesce(description, 'No figures, tables, or captions detected on this page.') as description from pages_ p left join ds using (doc_id, page_number)",
    ),
    "bbox_lookup_priority": q(
        ITEMS
        + ELEMENTS
        + """,
num as (select *, case kind when 'figure' then 'fig' else 'table' end || printf('_%02d_%02d', page_number, row_number() over (partition by doc_id, kind order by page_number, item_idx)) as item_id from items),
bo as (select doc_id, item_id, 0 as source, x1 from num union all select doc_id, item_id, 1, x1 from eli)""",
        "select * from bo qualify row_number() over (partition by doc_id, item_id order by source) = 1",
    ),
    "export_regions": q(DET + ELEMENTS + ANSWERS + REGIONS, f"select {P}, region_id, item_id, label, x1/1654.0::double*100.0::double as x, (y2-y1)/2339.0::double*100.0::double as height from reg"),
    "export_relations": q(DET + ELEMENTS + ANSWERS + REGIONS, "select a.doc_id, a.page_number, a.region_id as from_id, b.region_id as to_id, 'has_caption' as label from reg a join reg b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.o = b.o and a.part = 0 and b.part = 0 and a.sub = 0 and b.sub = 1"),
    "storage_urls": q(FILES, "select doc_id, '/data/local-files/?d=images/' || name || '/page_0001.png' as local_url, 'http://localhost:9000/pages/' || name as bucket_url from files"),
    "image_sizes": q(FILES, "select doc_id, case when doc_id % 2 = 0 then doc_id + 100 else 1654 end::bigint as width, case when doc_id % 3 = 0 then 50 else 2339 end::bigint as height from files"),
    "class_labels": q(DET, "select event_id, class_name || ': ' || printf('%.2f', round(confidence, 1)) as label from det"),
    "class_names": q(DET, "select event_id, class_name as label from det"),
    "numbered_labels": q(DET + ELEMENTS, f"select {P}, det_idx, case kind when 'figure' then 'F' when 'table' then 'T' else 'C' end || case when no < 3 then no else det_idx + 1 end as label from eli"),
    "color_lookup": q(DET, "select event_id, case class_name when 'Figure' then 0 when 'Table' then 255 else 50 end::bigint as b, case class_name when 'Figure' then 255 when 'Table' then 0 else 50 end::bigint as g, case class_name when 'Figure' then 0 when 'Table' then 0 else 50 end::bigint as r from det"),
    "label_boxes": q(DET, "select event_id, trunc(x1)::bigint as label_x, case when trunc(y1-100) < 30 then trunc(y1-100) else trunc(y1-100)-30 end::bigint as label_top, case when trunc(y1-100) < 30 then trunc(y1-100)+30 else trunc(y1-100) end::bigint as label_bottom from det"),
    "legend_layout": "select n_name as name, (30 + 35*n_nationkey)::bigint as y from nation where 30 + 35*n_nationkey + 25 <= 390",
    "image_media_types": q(FILES, "select doc_id, case doc_id % 5 when 0 then 'image/jpeg' when 1 then 'image/jpeg' when 2 then 'image/gif' when 3 then 'image/webp' else 'image/png' end as media_type, name as stem from files"),
    "model_names": "select n_nationkey, case when n_nationkey % 3 <> 0 and n_nationkey % 4 in (2, 3) then 'openai/' else '' end || case n_nationkey % 4 when 0 then 'gpt-' when 1 then 'ollama/' when 2 then '' else 'my/' end || lower(n_name) as name from nation",
    "api_errors": "select n_nationkey, case n_nationkey % 4 when 0 then 'Rate limit exceeded. Wait and retry, or reduce concurrency.' when 1 then 'Invalid request: boom ' || n_name when 2 then 'Model not found: ' || lower(n_name) || '. Check model name.' else 'API error: boom ' || n_name end as said from nation",
    "report_lines": q(BEST, "select 'doc' || doc_id as name, case when doc_id % 3 = 0 or count(*) < 10 then '| doc' || doc_id || ' | - | - | - | Error: ' || case when length('Predictions not found for doc' || doc_id) > 30 then ('Predictions not found for doc' || doc_id)[:27] || '...' else 'Predictions not found for doc' || doc_id end || ' |' else '| doc' || doc_id || ' | 0.2500 | 0.2500 | 0.2500 | OK |' end as line from comp group by doc_id", True),
    "report_sections": q(
        BEST,
        f"""select ord::bigint as ord, line from (select unnest(ls) as line, unnest(range(0, 14)) as ord from (select ['# Caption Matching Benchmark Report', '## Dataset Information', '- **Name:** set', '- **Version:** 1.0', '- **Total Documents:** 9', '- **Successful Evaluations:** 8', '## Overall Metrics', '| Precision | 0.5000 |', '| Recall | 0.2500 |', '| F1 Score | 1.0000 |', '## Detailed Counts',
'| True Positives | ' || tp || ' |', '| False Positives | ' || fp || ' |', '| False Negatives | ' || fn || ' |'] as ls from (select {COUNTS} from comp)))""",
        True,
    ),
    "point_ids": q(DET, "select event_id, md5('doc' || doc_id || ':' || det_idx || ':' || page_number) as point_id from det"),
    "base64_images": q(FILES, "select doc_id, to_base64(name::blob) as content from files"),
    "element_texts": "select n_nationkey, case when n_nationkey % 3 = 2 and n_nationkey % 2 = 0 then n_name || ' a caption' when n_nationkey % 3 = 2 then n_name when n_nationkey % 2 = 0 then 'a caption' else 'figure' end as text from nation",
    "matches_of_page": q(TRUTH, "select figure_id, kind from truth where page_number = 3", True),
    "elements_with_box": q(DET, f"select {P}, count(*) filter (det_idx % 5 <> 0) as with_box, count(*) filter (det_idx % 5 = 0) as without_box from det group by all"),
    "palette_upsert": "select * from (values ('Figure', 0::bigint, 0::bigint, 255::bigint, 0::bigint), ('Table', 1, 1, 2, 3), ('New', 3, 4, 5, 6)) t(name, ord, b, g, r)",
    "visualizer_labels": q(DET + ELEMENTS, f"select {P}, det_idx, case kind when 'figure' then 'F' when 'table' then 'T' else 'C' end || no as numbered, class_name as plain from eli"),
    "manifest_validity": q(MANIFEST, "select bool_and(doc_id % 5 <> 0) as valid, count(*) as total, count(*) filter (doc_id % 5 <> 0) as valid_documents, count(*) filter (doc_id % 5 = 0) as n_annotations, coalesce(string_agg(name, ',' order by name) filter (extraction_path is not null and doc_id % 3 <> 0), '') as missing_extractions from man"),
    "page_results": q(DET, f"select p.doc_id, p.page_number, count(det_idx) as num_detections, coalesce(string_agg(class_name, ',' order by det_idx), '') as classes from pages_ p left join det using (doc_id, page_number) group by all"),
    "document_results": q(DET, "select doc_id, 10::bigint as total_pages, null::double as processing_time_seconds, 10::bigint as n_pages, count(*) as total_detections from det group by doc_id"),
    "annotation_documents": q(
        DET + ELEMENTS + ANSWERS,
        f"""select {P}, (select count(*) from am where am.doc_id = a.doc_id and am.page_number = a.page_number) as n_matches,
coalesce((select string_agg(item_id, ',' order by no) from loosei l where ok and l.kind = 'caption' and l.doc_id = a.doc_id and l.page_number = a.page_number), '') as unmatched_captions,
(select count(*) from loosei l where ok and l.kind = 'figure' and l.doc_id = a.doc_id and l.page_number = a.page_number) as n_figures from ans a""",
    ),
    "direct_statistics": q(DET, "select doc_id, sum(f)::bigint as total_figures, sum(f)::bigint as total_tables, sum(f)::bigint as total_captions, sum(f)::bigint as total_matches, sum(case when page_number % 2 = 0 then f else 0 end)::bigint as matches_with_captions, sum(f)::bigint as pages_with_content from (select *, case when (doc_id+page_number)%4 < 2 then 1 else 0 end as f from pages_) group by doc_id"),
    "benchmark_documents": q(
        BEST.replace("where confidence >= 0.7", "where confidence >= 0.7 and doc_id % 5 <> 1"),
        f"""select doc_id, total, tp, fp, fn, precision, f1, false as failed from (select *, {PRF} from (select doc_id, {COUNTS} from comp group by doc_id))
union all select doc_id, 0, 0, 0, 0, 0.0, 0.0, false from truth where doc_id % 5 <> 1 and doc_id not in (select doc_id from comp) group by doc_id
union all select doc_id, null, null, null, null, null, null, true from truth where doc_id % 5 = 1 group by doc_id""",
        True,
    ),
    "benchmark_report": q(
        BEST.replace("where confidence >= 0.7", "where confidence >= 0.7 and doc_id % 5 <> 1"),
        f"""select part::bigint as part, line from (select unnest([0,0,0,0,0,0,0,0,0,0,0,1,3,3,3,5,7,8,9]) as part, unnest(['# Caption Matching Benchmark Report', '## Dataset Information', '- **Name:** set', '- **Version:** 1.0',
'- **Total Documents:** ' || (select count(distinct doc_id) from truth), '- **Successful Evaluations:** ' || (select count(distinct doc_id) from truth where doc_id % 5 <> 1), '## Overall Metrics', '## Detailed Counts',
'| True Positives | ' || tp || ' |', '| False Positives | ' || fp || ' |', '| False Negatives | ' || fn || ' |', '## Per-Type Metrics', '## Per-Document Results', '| Document | Precision | Recall | F1 | Status |', '|----------|-----------|--------|-----|--------|', '## Errors', '## Evaluator Configuration', '- **threshold:** 0.5', '*Report generated at t*']) as line from (select {COUNTS} from comp))
where part <> 5 or exists (select 1 from truth where doc_id % 5 = 1)""",
        True,
    ),
    "batch_outcome": q(FILES, "select count(*) filter (doc_id % 7 <> 0 and doc_id % 3 <> 0) as successes, count(*) filter (doc_id % 7 = 0 or doc_id % 3 = 0) as failures from files"),
    "comparison_pivot": q(RUNS, "select key, coalesce(max(value) filter (label = 'run0'), '-') as run0, coalesce(max(value) filter (label = 'run1'), '-') as run1, coalesce(max(value) filter (label = 'run2'), '-') as run2 from runs group by key"),
    "config_union": q(RUNS, "select distinct key from runs"),
    "topk_cosine": "select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double*q[i]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))) * sqrt(list_sum(list_transform(q, lambda x: x::double*x::double)))), 6) as similarity from embeddings, (select embedding as q from embeddings where vec_id = 0) order by 2 desc, 1 limit 10",
}
