"""Cleaning, tagging and extraction over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.base import case, derived, load, with_derived
from regdata.functions import clean, text
from regdata.operators import relate
from regdata.vocab import JOB_CLASSES, LAW_TERMS, ORDER_TERMS
from regdata.vocab import HTML_REFERENCES


def _flag_sql() -> str:
    out = []
    for term in ORDER_TERMS:
        out.append(f"case when contains(lower(text), '{term.lower()}') then 1 else 0 end as \"order_{term}\"")
    for name, terms in LAW_TERMS.items():
        hit = " or ".join(f"contains(lower(text), '{t.lower()}')" for t in terms)
        out.append(f"case when {hit} then 1 else 0 end as \"law_{name}\"")
    return ", ".join(out)


def all_flags() -> dict[str, list[str]]:
    return {**{f"order_{t}": [t] for t in ORDER_TERMS}, **{f"law_{n}": ts for n, ts in LAW_TERMS.items()}}


@case("keyword_flags", with_derived("enforcement", body=f"select id, {_flag_sql()} from enforcement"))
def keyword_flags(spark, d):
    e = derived(spark, d, "enforcement").select("id", "text")
    flags = text.keyword_flags(e, "text", all_flags())
    return flags.select("id", *[F.col(f"`{c}`").cast("int").alias(c) for c in all_flags()])


@case("document_flags", """
    select doc_id, case when contains(lower(text), 'the ') or contains(lower(text), 'le ') then 1 else 0 end as article,
           case when contains(lower(text), 'licen') then 1 else 0 end as licence, case when contains(lower(text), '@') then 1 else 0 end as address
    from documents
""")
def document_flags(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    flags = text.keyword_flags(docs, "text", {"article": ["The ", "le "], "licence": ["licen"], "address": ["@"]})
    return flags.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("article", "licence", "address")])


def _class_sql() -> str:
    whens = []
    for name, terms in JOB_CLASSES:
        whens.append("when " + " or ".join(f"contains(lower(job_title), '{t.lower()}')" for t in terms) + f" then '{name}'")
    return "case " + " ".join(whens) + " else 'OTHER' end"


@case("job_class_level", with_derived("staff", body=f"""
    select id, {_class_sql()} as job_class, case when regexp_extract(lower(job_title), ' (i{{1,3}}|iv|vi?)$', 1) = '' then 'NONE'
      else upper(regexp_extract(lower(job_title), ' (i{{1,3}}|iv|vi?)$', 1)) end as job_level from staff
"""))
def job_class_level(spark, d):
    s = derived(spark, d, "staff")
    return s.select("id", text.classify("job_title", JOB_CLASSES, "OTHER").alias("job_class"), text.roman_level("job_title").alias("job_level"))


@case("part_classes", """
    select p_partkey, case when contains(p_name, 'red') or contains(p_name, 'blue') then 'colour' when contains(p_name, 'ring') then 'ring' else 'OTHER' end as kind from part
""")
def part_classes(spark, d):
    rules = [("colour", ["RED", "blue"]), ("ring", ["ring"])]
    return load(spark, d, "part").select("p_partkey", text.classify("p_name", rules, "OTHER").alias("kind"))


_MONEY_TEXT = """
    select o_orderkey, case o_orderstatus
       when 'F' then 'Penalty of $' || replace(cast(cast(o_totalprice as decimal(18,2)) as varchar(30)), '.', ',500.') || ', later $1 million'
       when 'O' then 'agreed to $' || cast(o_custkey % 9 + 1 as varchar(5)) || '.25 million and $3,000'
       else case when o_orderpriority = '5-LOW' then 'no penalty was assessed'
                 else 'fined $' || cast(o_custkey % 900 + 1 as varchar(5)) || ' million in total' end end as t
    from orders
"""


@case("money_amounts", f"""
    with m as ({_MONEY_TEXT}),
    p as (select o_orderkey, t, regexp_extract(t, '\\$[0-9]{{1,3}}(?:,?[0-9]{{3}})*(?:\\.[0-9]{{2}})?\\b') as plain,
          regexp_extract(t, '\\$[0-9]{{1,3}}(?:,?[0-9]{{3}})*(?:\\.{{0,2}}[0-9]{{0,2}} million)\\b') as big from m)
    select o_orderkey, case when plain = '' then null when big <> '' and strpos(t, big) = strpos(t, plain)
      then cast(split_part(replace(replace(big, '$', ''), ',', ''), ' ', 1) as double) * 1e6
      else cast(replace(replace(plain, '$', ''), ',', '') as double) end as fine,
      case when plain = '' then null when big <> '' and split_part(split_part(big, '.', 1), ' ', 1) = plain
      then cast(split_part(replace(replace(big, '$', ''), ',', ''), ' ', 1) as double) * 1e6
      else cast(replace(replace(plain, '$', ''), ',', '') as double) end as fine_compat
    from p
""")
def money_amounts(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    m = spark.sql(_MONEY_TEXT)
    return m.select("o_orderkey", text.extract_money("t").alias("fine"), text.extract_money("t", compat=True).alias("fine_compat"))


@case("proper_noun_runs", """
    select doc_id, len(r) as n, array_to_string(list_transform(r, lambda x: ltrim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), '|') as runs
    from (select doc_id, regexp_extract_all(regexp_replace(replace(strip_accents(text), 'ß', 'ss'), '[^\\x00-\\x7F]', '', 'g'), '(?:\\s*\\b[A-Z][a-z\\-]+\\b)+') as r from documents)
""")
def proper_noun_runs(spark, d):
    docs = load(spark, d, "documents")
    runs = text.proper_nouns(text.to_ascii("text"))
    return docs.select("doc_id", F.size(runs).alias("n"), F.array_join(runs, "|").alias("runs"))


# a gazetteer from tables: first words of the pages' titles, and names of nations and regions
_GAZETTEER = """
    select upper(substr(w, 1, 1)) || lower(substr(w, 2)) as name from (select regexp_extract(html, '<title>([A-Za-z]+)', 1) as w from pages) where w <> ''
    union select upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) from nation union select upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) from region
"""


@case("gazetteer_tags", f"""
    with g as ({_GAZETTEER}),
    r as (select distinct doc_id, ltrim(unnest(regexp_extract_all(regexp_replace(replace(strip_accents(text), 'ß', 'ss'), '[^\\x00-\\x7F]', '', 'g'), '(?:\\s*\\b[A-Z][a-z\\-]+\\b)+')), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as run from documents),
    f as (select doc_id, string_agg(run, '|' order by run) as places, count(*) as n from r join g on run = name group by 1)
    select doc_id, coalesce(places, '') as places, coalesce(n, 0) as n from (select doc_id from documents) left join f using (doc_id)
""")
def gazetteer_tags(spark, d):
    for name in ("pages", "nation", "region"):
        load(spark, d, name).createOrReplaceTempView(name)
    names = spark.sql(_GAZETTEER)
    docs = load(spark, d, "documents").select("doc_id", text.to_ascii("text").alias("text"))
    tagged = relate.gazetteer_tags(docs, "doc_id", "text", names, "name")
    return tagged.select("doc_id", F.array_join("places", "|").alias("places"), F.size("places").alias("n"))


@case("member_tags", with_derived("enforcement", body="""
    select name, n, round(fine, 2) as fine from (
      select name, count(id) as n, coalesce(sum(fine), 0) as fine from
        (select n_name as name from nation union select r_name from region) g
        left join (select id, town as member, fine from enforcement union select id, county, fine from enforcement) e on member = name group by name)
"""))
def member_tags(spark, d):
    e = derived(spark, d, "enforcement").withColumn("places", F.array("town", "county", "town"))
    names = load(spark, d, "nation").select(F.col("n_name").alias("name")).union(load(spark, d, "region").select("r_name"))
    return relate.member_totals(e, "places", names, "name", "fine").withColumn("fine", F.round("fine", 2))


@case("page_links", """
    with l as (select page_id, replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '&amp;', '&') as href from pages)
    select page_id, href, regexp_extract(href, '[^/]*$') as name, count(*) as n from l group by 1, 2, 3
""")
def page_links(spark, d):
    hrefs = load(spark, d, "pages").select("page_id", F.explode(text.links("html")).alias("href"))
    return hrefs.groupBy("page_id", "href", text.base_name("href").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@case("odd_links", """
    select page_id, list_aggregate(['a.pdf?x=1&y=' || page_id, 'B/' || page_id, 'c' || page_id || '.pdf', ''], 'string_agg', ' ') as hrefs from pages
""")
def odd_links(spark, d):
    """Single, double and no quotes, any letter case, character references, and text that only looks like a link."""
    number = F.col("page_id").cast("string")
    html = F.concat(F.lit("<a href='a.pdf?x=1&amp;y="), number, F.lit("'>x</a><A HREF = \"B/"), number, F.lit("\">y</A> xhref=no <a class=k href=c"), number, F.lit(".pdf>z</a><a href=\"\">"))
    return load(spark, d, "pages").select("page_id", F.array_join(text.links(html), " ").alias("hrefs"))


@case("pdf_links", """
    with l as (select page_id, unnest(regexp_extract_all(replace(html, '">', '.pdf?x=1#top">'), 'href="([^"]*)"', 1)) as href, url from pages)
    select page_id, count(*) as n, min('http://' || split_part(url, '/', 3) || '/' || ltrim(href, '/')) as first_url from l
    where lower(split_part(split_part(href, '#', 1), '?', 1)) like '%.pdf' group by 1
""")
def pdf_links(spark, d):
    pages = load(spark, d, "pages").withColumn("html", F.replace("html", F.lit('">'), F.lit('.pdf?x=1#top">')))
    base = F.concat(F.lit("http://"), F.split_part("url", F.lit("/"), F.lit(3)))
    hrefs = pages.select("page_id", base.alias("base"), F.explode(text.links("html")).alias("href")).where(text.is_pdf("href"))
    return hrefs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min(text.join_url("base", "href")).alias("first_url"))


@case("html_table_rows", """
    select page_id, 'P & ' || page_id || ' \u2013 x' as "Page", url as "Address", case when page_id % 3 = 0 then null else length(html) || ' <kB>' end as "Size" from pages
    union all select page_id, 'second', 'b' || chr(233), null from pages
""")
def html_table_rows(spark, d):
    """A table before every page: cells and rows without end tags, a table within a cell, a repeated header, references, a short row."""
    from regdata.operators.markup import extract_table_rows

    p = load(spark, d, "pages")
    size = F.when(F.col("page_id") % 3 == 0, "N/A").otherwise(F.concat(F.length("html").cast("string"), F.lit(" &lt;kB&gt;")))
    head = "<tr><th>Page<th>Address<TH class=n>Size"
    page = F.concat(
        F.lit(f"<p>x</td></table><table border=1>{head}<tr><td>P &#38; "), F.col("page_id").cast("string"), F.lit(" &#x2013; x<td><a href='"), "url", F.lit("'>"), "url",
        F.lit("</a><table><tr><th>Size</th></tr><tr><td>inner<td>more</table><!-- <td>no --><td>"), size, F.lit(f"</td></tr>{head}</tr><tr><td>second</td><td>b&#233;</table>"), "html",
    )
    return extract_table_rows(p.select("page_id", page.alias("html")), ["page_id"], "html", ["Page", "Address", "Size"])


def sql_references(x: str) -> str:
    for reference, sign in HTML_REFERENCES.items():
        x = f"replace({x}, '&{reference};', chr({ord(sign)}))"
    return x


@case("page_headings", f"""
    select page_id, trim({sql_references("regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}, ' ') as title,
      split_part(split_part({sql_references("regexp_replace(html, '<[^>]*>', '', 'g')")}, ' (PDF', 1), chr(10), 1) as label from pages
""")
def page_headings(spark, d):
    return load(spark, d, "pages").select(
        "page_id", text.strip_tags(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"), text.facility_label("html").alias("label")
    )


_FIX = {"red plate": "Red Plate", "hot ring": "hot-ring", "old rod": "rod (old)"}


@case("text_corrections", """
    select p_partkey, case p_name when 'red plate' then 'Red Plate' when 'hot ring' then 'hot-ring' when 'old rod' then 'rod (old)' else p_name end as p_name from part
""")
def text_corrections(spark, d):
    return relate.corrections(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", _FIX)


_NUMBERS = """
    select o_orderkey, case o_orderstatus when 'F' then '$' || cast(o_custkey as varchar(20)) || ',234.50' when 'O' then 'not avail'
      else cast(o_custkey as varchar(20)) || '%' end as a, case when o_orderpriority = '5-LOW' then 'Not Monitored' else cast(o_custkey as varchar(20)) || '.5' end as b,
      case when o_orderpriority = '1-URGENT' then -666666666.0 else o_totalprice end as c from orders
"""


@case("clean_numbers", f"""
    select o_orderkey, try_cast(regexp_replace(a, '[,$%]', '', 'g') as double) as a, try_cast(b as double) as b, nullif(c::double, -666666666) as c from ({_NUMBERS})
""")
def clean_numbers(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    n = spark.sql(_NUMBERS)
    return n.select(
        "o_orderkey", clean.clean_number("a").alias("a"), clean.safe_double("b").alias("b"),
        clean.sentinel_to_null(F.col("c").cast("double"), -666666666.0).alias("c"),
    )


@case("fiscal_labels", """
    with f as (select o_orderkey, o_orderstatus as st, year(o_orderdate) as y from orders)
    select o_orderkey, 2000 + y % 100 as fiscal, case when st = 'F' then 1 else 0 end as governor, y + case when st = 'O' then 1 else 0 end as report from f
""")
def fiscal_labels(spark, d):
    o = load(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    short = F.concat(F.lit("FY"), F.right(F.col("y").cast("string"), F.lit(2)), F.when(F.col("o_orderstatus") == "F", " Gov").otherwise(""))
    span = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("FY "), F.col("y").cast("string"), F.lit("-"), (F.col("y") + 1).cast("string"))).otherwise(
        F.concat(F.lit("FY"), F.col("y").cast("string"))
    )
    o = o.select("o_orderkey", short.alias("short"), span.alias("span"))
    return o.select(
        "o_orderkey", clean.fiscal_year("short").alias("fiscal"), clean.governor_flag("short").alias("governor"), clean.report_year("span").alias("report")
    )


@case("person_names", """
    select c_custkey, 'First' || c_custkey as first, case when c_mktsegment = 'BUILDING' then 'Q' when c_mktsegment = 'FURNITURE' then 'R' end as middle_initial,
      'Last-' || c_nationkey as last from customer
""")
def person_names(spark, d):
    c = load(spark, d, "customer")
    middle = F.when(F.col("c_mktsegment") == "BUILDING", " Q.").when(F.col("c_mktsegment") == "FURNITURE", " X R").otherwise("")
    name = F.concat(F.lit("Last-"), F.col("c_nationkey").cast("string"), F.lit(", First"), F.col("c_custkey").cast("string"), middle)
    return c.select("c_custkey", clean.split_name(name).alias("n")).select("c_custkey", "n.*")


@case("place_split", """
    select n_nationkey, n_name as city, case when n_regionkey < 3 then r_name end as watershed, n_name as municipality,
      case when n_regionkey < 4 then '1/2/' || n_nationkey end as start, case when n_regionkey < 4 then '3/4/' || n_nationkey end as "end",
      case when n_regionkey = 1 then '5/6/17' end as extension,
      case n_regionkey when 0 then 'Percent from Federal Government' when 1 then 'Environmental Agency Budget' else 'Amount of Budget Percent' end as label
    from nation join region on n_regionkey = r_regionkey
""")
def place_split(spark, d):
    n = load(spark, d, "nation")
    n = n.join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region, key = F.col("n_regionkey"), F.col("n_nationkey").cast("string")
    place = F.concat(F.col("n_name"), F.when(region < 3, F.concat(F.lit(" ( "), F.col("r_name"), F.lit(" )"))).otherwise(""))
    census = F.concat(F.col("n_name"), F.when(region == 0, " CDP").when(region == 1, " city").otherwise(" town"), F.lit(", Some County, State"))
    period = F.when(region < 4, F.concat(F.lit("1/2/"), key, F.lit(" - 3/4/"), key, F.when(region == 1, " (Extended to 5/6/17)").otherwise(""))).otherwise("N/A")
    label = F.when(region == 0, "% from  Federal Government (e.g., EPA) ").when(region == 1, "Env. Agency\nBudget").otherwise("Amount  of Budget %")
    out = n.select(
        "n_nationkey", clean.city_and_watershed(place).alias("p"), clean.municipality_name(census).alias("municipality"),
        clean.comment_period(period).alias("c"), clean.budget_label(label).alias("label"),
    )
    return out.select("n_nationkey", "p.*", "municipality", "c.*", "label")


@case("ascii_folding", "select doc_id, strip_accents(text) as text from documents")
def ascii_folding(spark, d):
    return load(spark, d, "documents").select("doc_id", text.fold_ascii("text").alias("text"))


@case("transliterated", """
    select doc_id, replace(strip_accents(text), 'ß', 'ss') || ' Joe''s "x" - 2-3 -- 1 1/2 ... AEon <<ok>> 5 EUR ' || doc_id || '?' as text, 1 as lost from documents
""")
def transliterated(spark, d):
    signs = " Joe\u2019s \u201cx\u201d\u00a0\u2013 2\u20113 \u2014 1\u00bd \u2026 \u00c6on \u00abok\u00bb 5 \u20ac "
    docs = load(spark, d, "documents").select("doc_id", F.concat("text", F.lit(signs), F.col("doc_id").cast("string"), F.lit("\u4e2d?")).alias("text"))
    return docs.select("doc_id", text.to_ascii("text").alias("text"), text.unspelled("text").alias("lost"))


@case("list_literals", "select n_nationkey, upper(n_name) || '|' || upper('town of ' || n_name) as items from nation")
def list_literals(spark, d):
    literal = F.concat(F.lit("['"), F.col("n_name"), F.lit("', 'town of "), F.col("n_name"), F.lit("']"))
    return load(spark, d, "nation").select("n_nationkey", F.array_join(text.parse_list_literal(literal), "|").alias("items"))


_LINES = """
    select o_orderkey, case when o_orderstatus = 'F' then '' else cast(month(o_orderdate) as varchar(2)) || '/' || cast(day(o_orderdate) as varchar(2)) || '/' || substr(cast(year(o_orderdate) as varchar(4)), 3) end
      || case when o_orderpriority = '5-LOW' then ' ' else ': ' end || 'Order ' || o_orderpriority || ': rest' as line from orders
"""


@case("dated_lines", f"""
    select o_orderkey, split_part(line, ':', 1) as date, ltrim(split_part(line, ':', 2)) as text from ({_LINES})
    where regexp_matches(line, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}:')
""")
def dated_lines(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    lines = spark.sql(_LINES).where(text.dated_line("line"))
    return lines.select("o_orderkey", text.dated_line_parts("line").alias("p")).select("o_orderkey", "p.*")


@case("url_parts", """
    select page_id, regexp_extract(url, '[^/]*$') as name, split_part(split_part(url, '#', 1), '?', 1) as path,
      'https://host/files/' || regexp_extract(url, '[^/]*$') as stored from pages
""")
def url_parts(spark, d):
    name = text.base_name("url")
    return load(spark, d, "pages").select(
        "page_id", name.alias("name"), text.path_part("url").alias("path"), text.join_url(F.lit("https://host/files/"), name).alias("stored")
    )


@case("display_labels", """
    select o_orderkey, format('{:,}', cast(round(o_totalprice) as bigint)) as amount,
      '$' || format('{:,}', cast(floor(o_totalprice / 1000) as bigint) * 1000) || ' - ' || format('{:,}', cast(floor(o_totalprice / 1000) as bigint) * 1000 + 1000) as bin,
      case o_orderstatus when 'F' then 'Consent Order' else 'Wetlands' end as topic from orders
""")
def display_labels(spark, d):
    low = (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("long")
    flag = F.when(F.col("o_orderstatus") == "F", "order_consent order").otherwise("order_wetlands")
    return load(spark, d, "orders").select(
        "o_orderkey", text.grouped_number(F.round("o_totalprice").cast("long")).alias("amount"), text.dollar_range(low, low + 1000).alias("bin"),
        text.title_of_flag(flag).alias("topic"),
    )


@case("significant_digit", """
    select o_orderkey, round(o_totalprice / pow(10, floor(log10(o_totalprice)))) * pow(10, floor(log10(o_totalprice))) as lead from orders
""")
def significant_digit(spark, d):
    return load(spark, d, "orders").select("o_orderkey", clean.one_significant_digit("o_totalprice").alias("lead"))


@case("unit_rates", """
    select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0) * 1e5, 4) as rate, round(l_extendedprice / 1e6, 8) as millions, round(pow(2, l_tax), 8) as doubled from lineitem
""")
def unit_rates(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(clean.rate("l_extendedprice", "l_discount", 1e5), 4).alias("rate"),
        F.round(F.col("l_extendedprice") / 1e6, 8).alias("millions"), F.round(clean.doubling_ratio("l_tax"), 8).alias("doubled"),
    )


@case("parsed_times", """
    with e as (select event_id, case event_type when 'error' then 'unknown' when 'view' then strftime(ts, '%Y-%m-%dT%H:%M:%S')
                 else strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250' end as s from events)
    select event_id, try_cast(s as timestamp)::varchar as t, year(try_cast(s as timestamp))::double as y, month(try_cast(s as timestamp))::double as m from e
""")
def parsed_times(spark, d):
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = load(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "view", whole).otherwise(F.concat(whole, F.lit(".250"))).alias("s"),
    )
    t = clean.parse_timestamp("s")
    return e.select("event_id", t.cast("string").alias("t"), F.year(t).cast("double").alias("y"), F.month(t).cast("double").alias("m"))
