"""Named queries over the test tables, one for each operator family, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators import apparatus, classify, furniture, library, profile, reconstruct, repair, reports, segments
from foliant.sources import structured
from foliant.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Geometry of the page blocks that text lines stand for in these queries.
PER_PAGE, WIDTH, HEIGHT = 40, 595.0, 842.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.text_blocks(table(spark, sf_dir, "documents"))


#: The same lines in SQL: (doc_id text, flat_idx, text).
_SQL_LINES = """lines as (select cast(doc_id as varchar) doc_id, i - 1 as flat_idx, x[i] as text from (select doc_id, string_split(text, chr(10)) x from documents) d, unnest(range(1, len(x) + 1)) t(i) where trim(x[i]) <> '')"""
_SQL_HEADING = f"""case when regexp_matches(text, '^CAPITOLO\\s+[IVXLCDM]+(?:-BIS|-TER)?\\b') then 'CHAPTER' when regexp_matches(text, '^Capitolo\\s+(?:{T.ORDINALS})$') then 'CHAPTER'
  when regexp_matches(text, '^\\d+\\.\\d+\\.\\s+[\\p{{L}}\\p{{N}}_]') then 'SUB_PARAGRAPH' when regexp_matches(text, '^§\\s*\\d+(?:-bis|-ter)?\\.\\s+[\\p{{L}}\\p{{N}}_]') then 'PARAGRAPH'
  when regexp_matches(text, '^\\d+\\.\\s+[\\p{{L}}\\p{{N}}_]') then 'PARAGRAPH' end"""
_SQL_BUCKET = "case when {n} < 50 then 'MICRO' when {n} < 100 then 'SHORT' when {n} < 500 then 'MEDIUM' when {n} < 1000 then 'LONG' when {n} < 3000 then 'VERY_LONG' else 'MEGA' end"
_SQL_STRIPPED = "length(regexp_replace(regexp_replace(text, '^\\s*\\(?\\d+\\)\\s*', ''), '^\\s+|\\s+$', '', 'g'))"


#: Heads that lines get by their place, so that each kind of heading and of marker occurs.
HEADS = ("", "CAPITOLO IV ", "", "2.1. ", "§ 3. ", "", "7. ", "(12) ", "", "Capitolo ")
_SQL_NUMBERED = f"""{_SQL_LINES.replace('lines as', 'plain as', 1)}, lines as (select doc_id, flat_idx, {list(HEADS)!r}[flat_idx % {len(HEADS)} + 1] || case when flat_idx % {len(HEADS)} = 9 then 'Primo' else text end as text from plain)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("flat_idx") % len(HEADS)
    head = F.element_at(F.array(*map(F.lit, HEADS)), (k + 1).cast("int"))
    return _lines(spark, sf_dir).withColumn("text", F.concat(head, F.when(k == 9, "Primo").otherwise(F.col("text"))))


@query(f"""with {_SQL_NUMBERED}, k as (select coalesce({_SQL_HEADING}, 'BODY') category, {_SQL_STRIPPED} n from lines)
select category, case when n > 0 then {_SQL_BUCKET.format(n='n')} end length_category, count(*) n from k group by 1, 2""")
def length_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = classify.heading_lines(_numbered(spark, sf_dir))
    return lines.groupBy(F.coalesce("heading", F.lit("BODY")).alias("category"), T.note_length(F.col("text")).alias("length_category")).agg(F.count("*").alias("n"))


@query(f"with {_SQL_NUMBERED} select doc_id, cast(flat_idx as int) flat_idx, {_SQL_HEADING} heading, text from lines where {_SQL_HEADING} is not null")
def heading_pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.heading_lines(_numbered(spark, sf_dir)).where("heading is not null").select("doc_id", "flat_idx", "heading", "text")


def _distribution_sql(group: str) -> str:
    share = lambda a, b: f"round(100.0 * sum(case when n_chars >= {a}{f' and n_chars < {b}' if b else ''} then 1 else 0 end) / count(*), 2)"
    names = ("micro", "short", "medium", "long", "very_long", "mega")
    shares = ", ".join(f"{share(a, b)} {n}_percent" for n, a, b in zip(names, (0, 50, 100, 500, 1000, 3000), (50, 100, 500, 1000, 3000, None), strict=True))
    at = "list_sort(list(n_chars))"
    return f"""select {group}, count(*) n, min(n_chars) min, {at}[greatest(count(*) // 4, 1)] q1, cast(round_even(median(n_chars), 0) as bigint) median, {at}[greatest(3 * count(*) // 4, 1)] q3, max(n_chars) max,
  cast(round_even(avg(n_chars), 0) as bigint) mean, {shares} from documents group by {group}"""


@query(_distribution_sql("lang"))
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_distribution(table(spark, sf_dir, "documents"), ["lang"])


@query(_distribution_sql("lang, source"))
def length_distribution_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_distribution(table(spark, sf_dir, "documents"), ["lang", "source"])


@query(f"""with {_SQL_LINES}, l as (select d.source doc_id, d.doc_id page, lower(trim(regexp_replace(regexp_replace(d.lang || ' ' || (flat_idx + 1), '\\d+', '#', 'g'), '\\s+', ' ', 'g'))) as key, (flat_idx % {PER_PAGE}) / {PER_PAGE}.0 y from lines l join documents d on cast(d.doc_id as varchar) = l.doc_id),
p as (select source doc_id, count(*) n_pages from documents group by 1),
c as (select doc_id, key, count(distinct page) n, count(distinct case when y < 0.12 or y > 0.88 then page end) n_band from l where key <> '' group by 1, 2)
select c.doc_id, c.key, c.n n_pages from c join p using (doc_id) where n_band >= greatest(5, ceil(p.n_pages * 0.15)) or n >= greatest(5, ceil(p.n_pages * 0.5))""")
def repeated_line_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents whose pages are their texts; a line is its language and its number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "source", "lang")
    lines = _lines(spark, sf_dir).select(F.col("doc_id").cast("long").alias("page"), (F.col("flat_idx") + 1).alias("text"), ((F.col("flat_idx") % PER_PAGE) / float(PER_PAGE)).alias("y")).join(docs, "page").withColumnRenamed("source", "doc_id").withColumn("text", F.concat_ws(" ", "lang", "text"))
    return furniture.repeated_lines(lines, docs.groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n_pages")))


@query("""select doc_id, cast("offset" as int) "offset", count(distinct page) n_pages from (select source doc_id, doc_id page, n_chars % 3 as "offset" from documents where length(cast(doc_id + n_chars % 3 as varchar)) <= 4) group by 1, 2 having count(distinct page) >= 5""")
def folio_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents whose pages, texts by their ids, have folios that are off by their length."""
    docs = table(spark, sf_dir, "documents")
    return furniture.folios(docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), (F.col("doc_id") + F.col("n_chars") % 3).cast("string").alias("text")))


@query(f"""with {_SQL_NUMBERED}, l as (select doc_id, flat_idx // {PER_PAGE} page, regexp_matches(text, '[\\s.,]\\d{{1,4}}\\s*$') e from lines),
c as (select doc_id, cast(page as int) page, count(*) n_lines, count(*) filter (e) n_entries from l group by 1, 2)
select *, n_lines >= 6 and n_entries >= 0.35 * n_lines strong, n_entries >= 10 and n_entries >= 0.20 * n_lines weak from c""")
def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.index_pages(_numbered(spark, sf_dir).withColumn("page", F.floor(F.col("flat_idx") / PER_PAGE).cast("int")))


@query("""select conv_id, turn, cast(ceil(row_number() over (partition by conv_id order by turn) / 2.0) as int) page_number from conversations""")
def reading_order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.paginate(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 2).select("conv_id", "turn", "page_number")


@query("""select event_id, bound from (select event_id, event_type, max(case when event_type = 'view' then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) bound from events) where event_type <> 'view'""")
def note_marker_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return apparatus.bind_preceding(events, F.col("event_type") == "view", ["user_id"], "event_id", "event_id").select("event_id", "bound")


@query("""with s as (select event_id, user_id, value from events where event_type = 'purchase'), t as (select event_id, user_id, value from events where event_type = 'view'),
r as (select s.event_id, t.event_id target, row_number() over (partition by s.event_id order by abs(t.value - s.value), t.event_id) k from s join t using (user_id))
select s.event_id, r.target from s left join r on s.event_id = r.event_id and r.k = 1""")
def nearest_same_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sources = events.where("event_type = 'purchase'").select("event_id", "user_id", "value")
    targets = events.where("event_type = 'view'").select("user_id", F.col("value").alias("target_value"), F.col("event_id").alias("target_id"))
    return apparatus.nearest(sources, targets, ["user_id"], "value", "target_value", "target_id").select("event_id", "target")


@query("""with f as (select source, min(doc_id) target_node_id from documents where n_chars > 1000 group by 1) select d.doc_id, d.source, f.target_node_id from documents d left join f using (source)""")
def first_marker_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    notes = docs.where("n_chars > 1000").select("source", F.col("doc_id").alias("node_id"), F.col("doc_id").alias("ord"))
    return apparatus.bind_first_marker(docs.select("doc_id", "source"), notes, ["source"])


@query("""with m as (select conv_id, turn, role, length(text) > 400 opens, length(text) < 100 closes from conversations),
s as (select *, max(case when opens or closes then turn end) over (partition by conv_id order by turn rows between unbounded preceding and current row) last_turn from m)
select s.conv_id, s.turn, case when coalesce(o.opens, false) and s.role = 'user' and not s.opens then 'NOTE' else s.role end category from s left join m o on o.conv_id = s.conv_id and o.turn = s.last_turn""")
def state_region_retag(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("category"), F.length("text").alias("n"))
    out = reconstruct.carry_region(turns, F.col("n") > 400, F.col("n") < 100, {"user": "NOTE"})
    return out.select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "category")


@query("""with m as (select *, case when length(text) < 300 and lag(length(text)) over (partition by conv_id order by turn) < 300 then 0 else 1 end starts from conversations),
i as (select *, sum(starts) over (partition by conv_id order by turn rows between unbounded preceding and current row) island from m)
select conv_id, min(turn) turn, count(*) n_parts, string_agg(text, ' ' order by turn) text from i group by conv_id, island""")
def islands_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    before = F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    runs = reconstruct.islands(turns, ["conv_id"], ["turn"], F.coalesce((F.length("text") < 300) & (before < 300), F.lit(False)))
    return runs.groupBy("conv_id", "island").agg(F.min("turn").alias("turn"), F.count("*").alias("n_parts"), reconstruct.join_text(runs, [], "turn").alias("text")).drop("island")


@query("""with t as (select conv_id, turn, case when role = 'user' then 'Capitolo ' || (turn + 1) || '.' else text end as text, role = 'user' as is_number from conversations),
m as (select *, is_number and lead(is_number) over w is not null and not lead(is_number) over w as takes, lead(text) over w nxt from t window w as (partition by conv_id order by turn)),
q as (select *, coalesce(lag(takes) over (partition by conv_id order by turn), false) taken from m)
select conv_id, turn, case when takes then regexp_replace(text, '\\.$', '') || '. ' || nxt else text end title from q where not taken""")
def chapter_pair_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as chapters' numbers, the others as titles."""
    number = F.concat(F.lit("Capitolo "), F.col("turn") + 1, F.lit("."))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.lit("HEADING_1").alias("category"), F.when(F.col("role") == "user", number).otherwise(F.col("text")).alias("text"))
    return reconstruct.pair_chapters(turns).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), F.col("text").alias("title"))


@query("""with o as (select o_custkey, o_orderkey, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) s from orders)
select a.o_custkey, a.o_orderkey a_id, b.o_orderkey b_id from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.s <= b.s + 30 and b.s <= a.s + 30""")
def overlap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01"))
    ranges = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), day.alias("start"), (day + 30).alias("end"))
    return library.overlapping(ranges, ranges, ["o_custkey"]).where("a_id < b_id").select("o_custkey", "a_id", "b_id")


@query("select doc_id id, source from documents where doc_id not in (select doc_id from labels) and doc_id not in (select doc_id from documents where lang = 'en')")
def uncollocated_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return library.uncollocated(docs.select(F.col("doc_id").alias("id"), "source"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")), docs.where("lang = 'en'").select(F.col("doc_id").alias("document_id")))


@query("select o_orderkey id, o_orderdate last_opened_at from orders where o_orderstatus <> 'F' order by o_orderdate desc, o_orderkey limit 5")
def recents_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_opened_at"), (F.col("o_orderstatus") == "F").alias("hidden"))
    return library.recents(rows).select("id", "last_opened_at")


@query("""with a as (select lang category, count(*) g from documents group by 1), b as (select lang category, count(*) b from documents join labels using (doc_id) where quality = 1 group by 1),
j as (select coalesce(a.category, b.category) category, coalesce(g, 0) g, coalesce(b, 0) b from a full join b on a.category = b.category)
select category, g produced, b expected, case when b > 0 then round(abs(g - b) / b, 4) end relative_delta,
 case when b = 0 then 'NOT_COMPARABLE' when g = b then 'EXACT' when round(abs(g - b) / b, 4) <= 0.15 then 'CLOSE' else 'DIVERGENT' end band from j""")
def category_compare_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    count = lambda d: d.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    return reports.compare_counts(count(docs), count(docs.join(labels.where("quality = 1"), "doc_id")))


@query("""with s as (select doc_id, lang, n_chars, text like '%|%' has_bars from documents),
k as (select doc_id, round((case when lang = 'en' then 0.45 else 0 end) + (case when n_chars > 1000 then 0.2 else 0 end) + (case when has_bars then -0.3 else 0 end), 6) a,
 round((case when lang <> 'en' then 0.6 else 0 end) + (case when n_chars < 500 then 0.1 else 0 end), 6) b from s), c as (select doc_id, greatest(a, 0) a, greatest(b, 0) b from k)
select doc_id, case when greatest(a, b) < 0.6 then 'unknown_generic' when a >= b then 'first' else 'second' end profile_id, cast(case when greatest(a, b) >= 0.6 then greatest(a, b) else 0.0 end as double) confidence from c""")
def plugin_dispatch_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("has_bars", F.col("text").contains("|"))
    profiles = (
        profile.Profile("first", (("english", lambda: F.col("lang") == "en", 0.45), ("long", lambda: F.col("n_chars") > 1000, 0.2), ("bars", lambda: F.col("has_bars"), -0.3))),
        profile.Profile("second", (("foreign", lambda: F.col("lang") != "en", 0.6), ("short", lambda: F.col("n_chars") < 500, 0.1))),
    )
    return profile.dispatch(docs, profiles).select("doc_id", "profile_id", "confidence")


@query("""with b as (select p_type doc_id, p_brand font, cast(p_size % 3 as double) size, sum(length(p_name)) chars from part group by 1, 2, 3),
r as (select *, 100.0 * chars / sum(chars) over (partition by doc_id) dominance_percent, row_number() over (partition by doc_id order by chars desc, font, size) rank from b)
select doc_id, font, size, cast(chars as bigint) chars, round(dominance_percent, 6) dominance_percent, cast(rank as int) rank from r where rank <= 25""")
def font_dominance_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "part").select(F.col("p_type").alias("doc_id"), F.col("p_brand").alias("font"), (F.col("p_size") % 3).cast("double").alias("size"), F.col("p_name").alias("text"))
    return profile.font_dominance(spans).withColumn("dominance_percent", F.round("dominance_percent", 6))


@query("""with b as (select p_type, p_brand, sum(p_size) w, min(p_partkey) o from part group by 1, 2), r as (select *, row_number() over (partition by p_type order by w desc, o) k from b) select p_type, p_brand from r where k = 1""")
def dominant_color_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.most_of(table(spark, sf_dir, "part"), ["p_type"], "p_brand", F.col("p_size"), "p_partkey")


@query("select lower(t) tag, count(*) n from (select unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) t from pages) group by 1")
def html_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tag_histogram(table(spark, sf_dir, "pages"))


@query("""select c css_class, count(*) n from (select unnest(regexp_split_to_array(a, '\\s+')) c from (select unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) a from pages)) where c <> '' group by 1""")
def css_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.class_histogram(table(spark, sf_dir, "pages"))


@query("""select case when regexp_matches(t, '[A-Za-z][0-9]+[A-Za-z]') then 'digit_inside' when regexp_matches(t, '^[0-9]+$') then 'number' when regexp_matches(t, '^[A-Z]+$') then 'upper'
 when regexp_matches(t, '^[a-z]+$') then 'lower' when regexp_matches(t, '^[A-Z][a-z]+$') then 'title' else 'other' end token_class, count(*) n
from (select unnest(regexp_split_to_array(text, '\\s+')) t from documents) where t <> '' group by 1""")
def token_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_classes(table(spark, sf_dir, "documents"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w from documents) select doc_id, array_to_string(w[1:8], ' ') || case when len(w) > 8 then '…' else '' end preview, len(w) n_words from w""")
def word_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.preview(F.col("text")).alias("preview"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query("select source, cast(sum(cast('0x' || left(sha256(x), 15) as bigint)) as varchar) digest, count(*) n from (select source, concat_ws('|', cast(doc_id as varchar), lang, cast(n_chars as varchar)) x from documents) group by 1")
def binding_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.concat_ws("|", "doc_id", "lang", "n_chars").alias("x"))
    return rows.groupBy("source").agg(T.row_digest(F.col("x")).alias("digest"), F.count("*").alias("n"))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as blocks of one span each, on pages of ``PER_PAGE`` lines."""
    lines = _lines(spark, sf_dir).withColumn("page", F.floor(F.col("flat_idx") / PER_PAGE).cast("int"))
    y = (F.col("flat_idx") % PER_PAGE) * 20.0
    blocks = lines.select("doc_id", "flat_idx", "page", F.lit(50.0).alias("x0"), y.alias("y0"), F.least(F.lit(545.0), 50.0 + F.length("text") * 5.0).alias("x1"), (y + 18.0).alias("y1"))
    flags = F.when(F.col("text").rlike("^[0-9]"), 1).otherwise(0)
    spans = lines.select("doc_id", "flat_idx", F.col("flat_idx").alias("span_ord"), "text", (F.lit(8.0) + F.length("text") % 8).alias("size"), flags.alias("flags"))
    pages = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(WIDTH).alias("width_pt"), F.lit(HEIGHT).alias("height_pt"))
    return blocks, spans, pages


_SQL_BLOCKS = f"""{_SQL_LINES}, blocks as (select doc_id, flat_idx, flat_idx // {PER_PAGE} page, (flat_idx % {PER_PAGE}) * 20.0 y0, (flat_idx % {PER_PAGE}) * 20.0 + 18.0 y1, least(545.0, 50.0 + length(text) * 5.0) - 50.0 w, 8.0 + length(text) % 8 size, regexp_matches(text, '^[0-9]') sup, text from lines),
tier as (select *, case when w >= 0.7 * {WIDTH} and y0 <= 0.2 * {HEIGHT} and size >= 12 and (contains(lower(text), 'versione riservata') or contains(lower(text), 'biblioteca it. ciechi') or contains(lower(text), '© giuffrè')) then 'ARTIFACT_FILIGREE'
 when y1 <= 0.08 * {HEIGHT} and length(text) < 100 then 'ARTIFACT_PAGE_HEADER' when y0 >= 0.92 * {HEIGHT} and length(text) < 100 then 'ARTIFACT_FOOTER' when sup and regexp_matches(text, '^\\d{{1,4}}$') then 'CROSS_REFERENCE' else 'UNCLASSIFIED' end category from blocks)"""


@query(f"with {_SQL_BLOCKS} select doc_id, cast(flat_idx as int) flat_idx, cast(page as int) page, category from tier")
def tier1_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(*_blocks(spark, sf_dir)).select("doc_id", "flat_idx", "page", "category")


@query(f"with {_SQL_BLOCKS} select doc_id, category, count(*) n from tier group by 1, 2")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_counts(classify.classify(*_blocks(spark, sf_dir)))


@query(f"with {_SQL_BLOCKS} select doc_id, cast(flat_idx as int) flat_idx, cast(row_number() over (partition by doc_id order by page, y0, flat_idx) - 1 as int) ord from blocks")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.reading_order(_blocks(spark, sf_dir)[0]).select("doc_id", "flat_idx", "ord")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in reading order with a category by length: short lines are headings or notes, long ones bodies."""
    blocks, spans, pages = _blocks(spark, sf_dir)
    rows = classify.reading_order(blocks).join(spans.select("doc_id", "flat_idx", "text"), ["doc_id", "flat_idx"]).join(pages, ["doc_id", "page"])
    n = F.length("text")
    category = F.when(n < 8, "HEADING_1").when(n < 16, "HEADING_2").when(n < 24, "HEADING_3").when(n < 40, "NOTE").otherwise("BODY")
    return rows.withColumn("category", category)


@query(f"""with {_SQL_BLOCKS}, items as (select *, row_number() over (partition by doc_id order by page, y0, flat_idx) - 1 ord, case when length(text) < 8 then 'HEADING_1' when length(text) < 16 then 'HEADING_2' when length(text) < 24 then 'HEADING_3' when length(text) < 40 then 'NOTE' else 'BODY' end cat from blocks),
w as (select *, max(case when cat = 'BODY' then ord end) over b last_body, max(case when cat like 'HEADING%' then ord end) over b last_barrier from items window b as (partition by doc_id order by ord rows between unbounded preceding and 1 preceding)),
j as (select *, coalesce(cat = 'BODY' and y0 < 0.12 * {HEIGHT} and ({_SQL_HEADING}) is null and last_body is not null and coalesce(last_barrier, -1) < last_body, false) joins from w),
h as (select *, case when joins then max(case when cat = 'BODY' and not joins then ord end) over (partition by doc_id order by ord rows between unbounded preceding and current row) else ord end head from j)
select doc_id, cast(head as int) ord, string_agg(text, ' ' order by ord) text, count(*) n_blocks from h group by doc_id, head""")
def merge_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconstruct.merge_continuations(_items(spark, sf_dir).select("doc_id", "ord", "category", "text", "y0", "height_pt", "flat_idx", "page"))
    return out.select("doc_id", "ord", "text", F.size("block_indices").cast("long").alias("n_blocks"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the same lines, with articles among the categories."""
    n = F.length("text")
    category = F.when(n < 24, F.col("category")).when(n < 28, "ARTICLE_HEADER").when(n < 34, "ARTICLE_BODY").otherwise(F.col("category"))
    items = _items(spark, sf_dir).withColumn("category", category).select("doc_id", "ord", "category", "page", "text", F.array("flat_idx").alias("block_indices"))
    return reconstruct.assemble(items)[0]


#: The same forest in SQL: places in the stack of headings, their paths, and every node's path, which gives the order.
_SQL_NODES = f"""{_SQL_BLOCKS},
its as (select doc_id, page, text, row_number() over (partition by doc_id order by page, y0, flat_idx) - 1 k, case when length(text) < 8 then 'HEADING_1' when length(text) < 16 then 'HEADING_2' when length(text) < 24 then 'HEADING_3' when length(text) < 28 then 'ARTICLE_HEADER'
 when length(text) < 34 then 'ARTICLE_BODY' when length(text) < 40 then 'NOTE' else 'BODY' end category from blocks),
hd as (select *, cast(right(category, 1) as int) lvl, row_number() over (partition by doc_id order by k) h from its where category like 'HEADING%'),
hp as (select *, least(h + min(lvl - h) over (partition by doc_id order by k), h) place from hd),
hm as (select *, max(case when place = 1 then k end) over b m1, max(case when place = 2 then k end) over b m2 from hp window b as (partition by doc_id order by k rows between unbounded preceding and 1 preceding)),
hq as (select *, case when lvl <> place then null when lvl = 2 then m1 when lvl = 3 then m2 end par from hm),
hh as (select c.doc_id, c.k, list_filter([p.par, c.par, c.k], lambda x: x is not null) path from hq c left join hq p on p.doc_id = c.doc_id and p.k = c.par),
cur as (select *, max(case when category like 'HEADING%' then k end) over b hk, max(case when category = 'ARTICLE_HEADER' then k end) over b ak from its window b as (partition by doc_id order by k rows between unbounded preceding and 1 preceding)),
nodes as (select c.doc_id, c.page, c.text, c.k, c.category, coalesce(own.path, coalesce(top.path, []) || case when c.ak > coalesce(c.hk, -1) and c.category in ('ARTICLE_BODY', 'NOTE') then [c.ak] else [] end || [c.k]) path
 from cur c left join hh own on own.doc_id = c.doc_id and own.k = c.k left join hh top on top.doc_id = c.doc_id and top.k = c.hk),
forest as (select doc_id, 'node_' || lpad(cast(k as varchar), cast(greatest(4, length(cast(k as varchar))) as int), '0') node_id, path, page, text, category, k, cast(row_number() over (partition by doc_id order by path) - 1 as int) ord, cast(len(path) - 1 as int) depth,
 case when category = 'NOTE' and {_SQL_STRIPPED} > 0 then {_SQL_BUCKET.format(n=_SQL_STRIPPED)} end length_category from nodes)"""


@query(f"""with {_SQL_NODES} select doc_id, node_id, case when len(path) > 1 then 'node_' || lpad(cast(path[-2] as varchar), cast(greatest(4, length(cast(path[-2] as varchar))) as int), '0') end parent_id, ord, depth,
 cast(row_number() over (partition by doc_id, path[-2] order by k) - 1 as int) sibling_idx, category, length_category from forest""")
def heading_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("doc_id", "node_id", "parent_id", "ord", "depth", "sibling_idx", "category", "length_category")


@query(f"""with {_SQL_NODES} select doc_id, node_id, ord, cast(ord + (select count(*) from forest g where g.doc_id = f.doc_id and len(g.path) > len(f.path) and g.path[1:len(f.path)] = f.path) as int) subtree_end from forest f""")
def subtree_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.subtree_end(_nodes(spark, sf_dir)).select("doc_id", "node_id", "ord", "subtree_end")


@query()
def fused_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select("doc_id", "ord", "category", "page", "text", "x0", "y0", "y1", "height_pt", F.lit("body").alias("signature"), F.array("flat_idx").alias("block_indices"))
    return reconstruct.fuse_headings(items).select("doc_id", "ord", "category", "text")


@query(f"""with {_SQL_NODES} select doc_id, count(*) n_nodes, max(depth) + 1 max_depth, {', '.join(f"count(*) filter (category = 'HEADING_{k}') n_heading_{k}" for k in range(1, 5))},
 {', '.join(f"count(*) filter (category = 'NOTE' and length_category = '{c}') n_{c.lower()}" for c in ('MICRO', 'SHORT', 'MEDIUM', 'LONG', 'VERY_LONG', 'MEGA'))} from forest group by doc_id""")
def document_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.topology(_nodes(spark, sf_dir))


@query(f"""with {_SQL_NODES}, up as (select doc_id, page, unnest(path) a from forest) select f.doc_id, f.node_id, f.depth, f.category, f.ord lo, cast(min(up.page) as int) first_page, cast(max(up.page) as int) last_page
 from forest f join up on up.doc_id = f.doc_id and up.a = f.k where f.category like 'HEADING%' group by all""")
def outline_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.outline_ranges(_nodes(spark, sf_dir)).drop("title")


@query()
def reading_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = segments.build_segments(_nodes(spark, sf_dir))
    return segments.paginate(segments.granularize(segments.layout(built, "quick")), ["doc_id"], ["ord", "part"]).select("doc_id", "ord", "part", "role", "text", "page_number")


@query("""with t as (select conv_id, turn, role, length(text) % 5 n from conversations),
b as (select conv_id, turn, role, n, max(case when role = 'user' then turn end) over (partition by conv_id, n order by turn rows between unbounded preceding and 1 preceding) target from t)
select cast(conv_id as varchar) doc_id, 'node_' || turn src_node_id, cast(n as int) n, 'node_' || target target_node_id, case when target is null then 'unresolved_cross_reference_node_node_' || turn || '_n_' || n end warning from b where role <> 'user'""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as notes and references, numbered by length: the last earlier note of a number in the conversation."""
    turns = table(spark, sf_dir, "conversations")
    n = (F.length("text") % 5).cast("string")
    nodes = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("node_"), "turn").alias("node_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "NOTE").otherwise("CROSS_REFERENCE").alias("category"), F.when(F.col("role") == "user", F.concat(n, F.lit(". "), "text")).otherwise(n).alias("text"), F.array().cast("array<string>").alias("scopes"))
    return apparatus.bind_cross_references(nodes)


@query("""with t as (select conv_id, turn, role, length(text) n from conversations), c as (select *, case when n % 7 = 0 then 'HEADING_1' when n % 7 = 1 then 'HEADING_2' when role = 'user' then 'NOTE' else 'CROSS_REFERENCE' end category, n % 2 m from t),
h as (select *, max(case when category like 'HEADING%' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) hd from c)
select cast(conv_id as varchar) doc_id, turn, cast(m as int) n, (select max(x.turn) from h x where x.conv_id = h.conv_id and x.category = 'NOTE' and x.m = h.m and x.turn < h.turn and x.turn > coalesce(h.hd, -1)) target from h where category = 'CROSS_REFERENCE'""")
def scoped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as headings, notes and references; the forest gives the scopes."""
    n, turn = F.length("text"), F.col("turn").cast("string")
    category = F.when(n % 7 == 0, "HEADING_1").when(n % 7 == 1, "HEADING_2").when(F.col("role") == "user", "NOTE").otherwise("CROSS_REFERENCE")
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("ord"), category.alias("category"), F.lit(0).alias("page"), F.concat((n % 2).cast("string"), F.when(category == "NOTE", F.concat(F.lit(". "), turn)).otherwise("")).alias("text"), F.array(F.col("turn").cast("int")).alias("block_indices"))
    nodes = reconstruct.assemble(items)[0]
    place = nodes.select("doc_id", F.col("node_id"), F.element_at("block_indices", 1).cast("long").alias("turn"))
    bound = apparatus.bind_cross_references(apparatus.with_scopes(nodes))
    out = bound.join(place.withColumnRenamed("node_id", "src_node_id"), ["doc_id", "src_node_id"]).join(place.select("doc_id", F.col("node_id").alias("target_node_id"), F.col("turn").alias("target")), ["doc_id", "target_node_id"], "left")
    return out.select("doc_id", "turn", "n", "target")


@query("""with t as (select conv_id, turn, role, length(text) n from conversations), p as (select conv_id, turn // 2 page, n % 3 k, turn from t where role = 'user'), c as (select conv_id, page, k, count(*) c, min(turn) id from p group by all),
l as (select conv_id, page, max(k) last_n from p group by all), m as (select conv_id, turn, turn // 2 page, n % 3 k from t where role <> 'user'),
j as (select m.conv_id, m.turn, case when s.c = 1 then s.id when s.c is null and a.c = 1 and m.k = coalesce(l.last_n, 0) + 1 then a.id end note_id from m left join c s on s.conv_id = m.conv_id and s.page = m.page and s.k = m.k
 left join c a on a.conv_id = m.conv_id and a.page = m.page + 1 and a.k = m.k left join l on l.conv_id = m.conv_id and l.page = m.page)
select conv_id, turn, case when note_id is not null and row_number() over (partition by conv_id, note_id order by turn) = 1 then note_id end note_id from j""")
def bind_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("page", F.floor(F.col("turn") / 2)).withColumn("n", F.length("text") % 3).withColumn("doc_id", F.col("conv_id")).withColumn("article", F.lit(None).cast("string"))
    markers = turns.where("role <> 'user'").select("doc_id", F.col("turn").alias("marker_id"), "page", "article", "n", F.col("turn").alias("ord"))
    notes = turns.where("role = 'user'").select("doc_id", F.col("turn").alias("note_id"), "page", "article", "n")
    return apparatus.bind_cascade(markers, notes).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "note_id")


@query(f"""with t as (select conv_id, turn, case when turn % 2 = 0 then '1. ' || text else text end as text, turn % 2 = 1 and turn - lag(turn) over (partition by conv_id order by turn) = 1 joins from conversations),
i as (select *, sum(case when joins then 0 else 1 end) over (partition by conv_id order by turn rows between unbounded preceding and current row) island from t),
m as (select conv_id doc_id, min(turn) ord, 'node_' || min(turn) node_id, cast(min(turn) as int) page_index, string_agg(text, ' ' order by turn) as text from i group by conv_id, island)
select *, case when {_SQL_STRIPPED} > 0 then {_SQL_BUCKET.format(n=_SQL_STRIPPED)} end length_category from m""")
def cross_page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    notes = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat(F.lit("node_"), "turn").alias("node_id"), F.col("turn").cast("int").alias("page_index"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("1. "), "text")).otherwise(F.col("text")).alias("text"))
    return repair.merge_cross_page_notes(notes)[0]


@query(r"""with t as (select conv_id, turn, (case when turn > 0 then '… ' else '' end) || text || (case when turn < 1 then ' …' else '' end) as text from conversations),
p as (select *, turn = 0 and lead(turn) over w is not null as head, turn = 1 and lag(turn) over w is not null as tail, lead(text) over w nxt from t window w as (partition by conv_id order by turn))
select conv_id doc_id, turn ord, 'node_' || turn node_id, case when head then regexp_replace(text, '\s*(?:\.\.\.|…)\s*$', '') || ' ' || regexp_replace(nxt, '^\s*(?:\.\.\.|…)\s*', '') else text end as text, case when head then 2 else 1 end n_parts from p where not tail""")
def ellipsis_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    text = F.concat(F.when(F.col("turn") > 0, "… ").otherwise(""), F.col("text"), F.when(F.col("turn") < 1, " …").otherwise(""))
    return repair.recompose_ellipses(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat(F.lit("node_"), "turn").alias("node_id"), text.alias("text")))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-zàèéìòù]+", -1)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5").select("word")


@query()
def dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words are cut at a line's end, and joined again where the lexicon has them."""
    docs = table(spark, sf_dir, "documents")
    cut = F.regexp_replace("text", "([a-z]{3})([a-z]{3})", "$1-\n$2")
    nodes = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("node_0000").alias("node_id"), F.lit(0).alias("page_index"), F.lit("BODY").alias("category"), cut.alias("text"), F.lit(None).cast("string").alias("length_category"))
    out, log = repair.dehyphenate(nodes, _lexicon(spark, sf_dir))
    edits = log.groupBy("doc_id").agg(F.count("*").alias("n_edits"))
    return out.select("doc_id", F.length("text").alias("n_chars")).join(edits, "doc_id", "left").withColumn("n_edits", F.coalesce("n_edits", F.lit(0)))


@query()
def ocr_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    tokens = lexicon.where(F.length("word") >= 5).select(F.regexp_replace("word", "o", "0").alias("token")).where(F.col("token").contains("0"))
    return repair.correct_tokens(tokens, lexicon)


@query()
def ocr_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their o misread as 0, and what the two steps for scans make of them."""
    text = F.regexp_replace(F.regexp_replace("text", "([a-z])o([a-z])", "$10$2"), "([a-z]{4})([a-z]{4})", "$1-\n$2")
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("node_0000").alias("node_id"), F.lit(0).alias("ord"), F.lit(0).alias("page_index"), F.lit("BODY").alias("category"), text.alias("text"), F.lit(None).cast("string").alias("length_category"))
    chosen = nodes.select("doc_id", F.lit("enciclopedia_storica").alias("profile_id"))
    out, log = repair.post_process(nodes, chosen, _lexicon(spark, sf_dir), {p.name: p.steps for p in profile.PROFILES})
    edits = log.groupBy("doc_id").agg(F.count("*").alias("n_edits"))
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256")).join(edits, "doc_id", "left").withColumn("n_edits", F.coalesce("n_edits", F.lit(0)))


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(segments.sentences(F.col("text"))).alias("k", "sentence"))


@query()
def granularize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("BODY").alias("role"), "text")
    return segments.granularize(docs).select("doc_id", "part", F.length("text").alias("n_chars"))


@query()
def memory_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("marker_start", F.length("text"))
    return segments.memory_refresh(docs).select("doc_id", "memory_refresh")


@query()
def xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as legal XML, one article for each line, and parsed again."""
    escape = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    articles = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit('<article eId="a'), i.cast("string"), F.lit('"><num>'), (i + 1).cast("string"), F.lit("</num><paragraph><p>"), escape(x), F.lit("</p></paragraph></article>"))), "")
    xml = F.concat(F.lit('<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><body>'), articles, F.lit("</body></act></akomaNtoso>"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), xml.cast("binary").alias("content"))
    return structured.parse_xml(files).select("path", "ord", "depth", "category", "text")


@query()
def xml_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return structured.xml_health(files).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""select lang, count(*) n from (select doc_id, lang from documents where n_chars > 500 union select doc_id, lang from documents where source = 'src0') group by 1""")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("n_chars > 500").select("doc_id", "lang").union(docs.where("source = 'src0'").select("doc_id", "lang")).distinct().groupBy("lang").agg(F.count("*").alias("n"))


@query("select doc_id from labels except select doc_id from documents where n_chars > 1000")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id").subtract(table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id"))


@query("select doc_id from labels where toxic = 1 intersect select doc_id from documents where lang = 'en'")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").intersect(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))


@query("""with o as (select cast(c_custkey as varchar) k, cast(c_nationkey as varchar) v from customer), n as (select cast(o_custkey as varchar) k, cast(count(*) as varchar) v from orders group by 1)
select coalesce(o.k, n.k) as key, case when o.k is null then 'added' when n.k is null then 'removed' else 'changed' end change, o.v as old, n.v as new from o full join n on o.k = n.k where o.k is null or n.k is null or o.v <> n.v""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations before, numbers of their orders after."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return reports.snapshot_diff(customers, counts)


@query("select source, lang, doc_id from (select source, lang, doc_id, row_number() over (partition by source, lang order by n_chars desc, doc_id) k from documents) where k = 1")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("ord", F.struct(-F.col("n_chars"), "doc_id"))
    return reconstruct.keep_first(docs, ["source", "lang"])[0].select("source", "lang", "doc_id")


@query("""select doc_id, trim(regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) slug,
 round(len(regexp_extract_all(text, '\\p{Lu}')) / greatest(len(regexp_extract_all(text, '\\p{L}')), 1), 6) caps_ratio, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) n_collapsed from documents""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.slug(F.concat_ws(" ", "source", "lang")).alias("slug"), F.round(T.caps_ratio(F.col("text")), 6).alias("caps_ratio"), F.length(T.collapse(F.col("text"))).cast("long").alias("n_collapsed"))


@query("select cast(doc_id as bigint) id, lang title from documents where contains(lower(lang), 'e') or contains(lower(source), 'e')")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("source_file_name"))
    return library.search(rows, " E ").select("id", "title")


@query("select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.event_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""with l as (select conv_id, turn, length(text) % 4 + 1 lv from conversations) select l.conv_id, l.turn, (select max(p.turn) from l p where p.conv_id = l.conv_id and p.turn < l.turn and p.lv < l.lv) parent_ord from l""")
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), (F.length("text") % 4 + 1).alias("level"))
    return segments.outline_parents(turns).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "parent_ord")


@query("""select o_orderkey id, case when o_orderpriority like '1%' then o_orderstatus || '!' else o_orderstatus end title, o_orderdate last_opened_at from orders order by 1""")
def library_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), "!").otherwise(""))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), title.alias("title"), F.col("o_orderdate").alias("last_opened_at"))
    return library.sort_documents(rows, "opened")


@query("""select cast(doc_id as varchar) doc_id, cast(strpos(text, word) - 1 as int) as "start", cast(strpos(text, word) - 1 + length(word) as int) as "end" from (select doc_id, text, regexp_extract(text, '[a-z]{6,}') word from documents) where strpos(text, word) > 0 and word <> ''""")
def children_in_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text as a node, its first long word as its child."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.col("text").rlike("[a-z]{6,}"))
    parents = docs.select("doc_id", F.lit("p").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "text")
    children = docs.select("doc_id", F.lit("c").alias("node_id"), F.lit("p").alias("parent_id"), F.regexp_extract("text", "[a-z]{6,}", 0).alias("text"))
    return segments.place_children(parents.unionByName(children)).select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("""select doc_id, case when len(w) > 18 then array_to_string(w[1:18], ' ') || '…' else array_to_string(w, ' ') end title from (select doc_id, list_filter(regexp_split_to_array(regexp_replace('(3) ' || text, '^\\s*\\(?\\d+\\)?[.\\s]\\s*', ''), '\\s+'), lambda x: x <> '') w from documents)""")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", segments.note_title(F.concat(F.lit("(3) "), "text")).alias("title"))
