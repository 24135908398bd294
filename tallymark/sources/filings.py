"""Sources and sinks: nested fact JSON, filing indexes, filing HTML and its sections, JSON lines, landing tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FACT_COLUMNS
from ..workers import ship

_ENTRY = "struct<start:string,end:string,val:double,fy:int,fp:string,form:string,filed:string,accn:string>"
COMPANY_FACTS = f"struct<cik:string,facts:map<string,map<string,struct<label:string,units:map<string,array<{_ENTRY}>>>>>>"

# Block tags, the least length of a chunk, and the section headings of each form.
BLOCKS = ("div", "p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
MIN_CHUNK = 20
_SEP = "[\\s ]*[.\\-–—]?[\\s ]*"
SECTIONS = {
    "10-K": (f"(?i)Item[\\s ]*7{_SEP}Management.{{0,3}}s[\\s ]+Discussion", [f"(?i)Item[\\s ]*7A{_SEP}Quantitative", f"(?i)Item[\\s ]*8{_SEP}Financial[\\s ]+Statements"]),
    "10-Q": (f"(?i)Item[\\s ]*2{_SEP}Management.{{0,3}}s[\\s ]+Discussion", [f"(?i)Item[\\s ]*3{_SEP}Quantitative"]),
}
#: Why a filing has no section.
NO_START, NO_END, NO_PAIR = "no start heading", "no end heading", "no end heading after a start heading"


def flatten_facts(raw: DataFrame, taxonomy: str = "us-gaap", concepts: list[str] | None = None) -> DataFrame:
    """raw (ticker, body: JSON text) to one row per (concept, unit, entry); the allow-list applies before anything is exploded."""
    j = raw.select(F.upper("ticker").alias("ticker"), F.from_json("body", COMPANY_FACTS).alias("j"))
    tax = F.col("j.facts")[taxonomy]
    if concepts:
        tax = F.map_filter(tax, lambda k, _: k.isin(concepts))
    rows = j.select("ticker", F.lpad(F.col("j.cik"), 10, "0").alias("cik"), F.explode(tax).alias("concept", "c"))
    rows = rows.select("ticker", "cik", "concept", F.col("c.label").alias("label"), F.explode("c.units").alias("unit", "entries"))
    rows = rows.select("ticker", "cik", "concept", "label", "unit", F.posexplode("entries").alias("pos", "e"))
    order = Window.partitionBy("ticker").orderBy("concept", "unit", "pos")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "ticker", "cik", "concept", "label", F.col("e.val").alias("value"), "unit", F.col("e.start").alias("period_start"), F.col("e.end").alias("period_end"), F.col("e.fy").alias("fiscal_year"),
        F.col("e.fp").alias("fiscal_period"), blank("e.form").alias("form"), blank("e.filed").alias("filed"), blank("e.accn").alias("accession_number"), F.row_number().over(order).cast("long").alias("fact_ord"),
    ).select(*FACT_COLUMNS)


def read_facts(spark: SparkSession, path: str, **options) -> DataFrame:
    """Fact JSON files, one company each, the ticker being the file's name."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("ticker"), F.col("value").alias("body"))
    return flatten_facts(raw, **options)


def list_concepts(facts: DataFrame) -> DataFrame:
    return facts.select("concept").distinct().orderBy("concept")


INDEX_FIELDS = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument", "primaryDocDescription")


def filing_index(raw: DataFrame, forms: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """raw (ticker, cik, and the index's parallel arrays) to one row per filing in index order, at most `limit` a company."""
    rows = raw.select("ticker", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.posexplode(F.arrays_zip(*INDEX_FIELDS)).alias("pos", "z"))
    if forms:
        rows = rows.where(F.col("z.form").isin(*forms))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy("pos")))
    if limit:
        rows = rows.where(F.col("rn") <= limit)
    out = rows.select("ticker", "cik", F.col("z.accessionNumber").alias("accession_number"), F.col("z.form").alias("form"), F.col("z.filingDate").alias("filing_date"), F.col("z.reportDate").alias("report_date"), F.col("z.primaryDocument").alias("primary_document"), "rn")
    return out.withColumn("filing_path", F.concat_ws("/", F.col("cik").cast("long").cast("string"), F.replace("accession_number", F.lit("-"), F.lit("")), "primary_document"))


# Fixed value: where filed documents are kept.
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def with_url(index: DataFrame, archive: str = ARCHIVE) -> DataFrame:
    """Filing rows with the address of the primary document."""
    return index.withColumn("filing_url", F.concat(F.lit(archive), F.col("filing_path")))


def search_candidates(hits: DataFrame) -> DataFrame:
    """cik, name and file_date of landed search hits (ord, ciks, names, file_date): hits without a cik go, the last hit of a cik wins."""
    first = hits.where(F.size("ciks") > 0).select(F.lpad(F.col("ciks")[0], 10, "0").alias("cik"), "ord", F.try_element_at("names", F.lit(1)).alias("name"), "file_date")
    return first.groupBy("cik").agg(F.max_by(F.struct("name", "file_date"), "ord").alias("x")).select("cik", "x.*")


def only_companies(rows: DataFrame, tickers: DataFrame | None) -> DataFrame:
    """rows of an explicit list of companies, where one is given."""
    if tickers is None:
        return rows
    return rows.join(tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct(), "ticker", "left_semi")


def original_chunks(wanted: DataFrame, index: DataFrame, chunks: DataFrame, most: int = 60) -> DataFrame:
    """The first chunks of each wanted filing (ticker, accession_number) that the index knows."""
    known = wanted.join(index.select("ticker", "accession_number"), ["ticker", "accession_number"], "left_semi").select("accession_number").distinct()
    return chunks.where(F.col("chunk_index") < most).join(known, "accession_number", "left_semi")


def long_texts(chunks: DataFrame, order: list[str], least: int = 400, n: int = 15) -> DataFrame:
    """The first n chunks longer than `least` characters, as a sample to price."""
    return chunks.where(F.length("text") > least).orderBy(*order).limit(n)


def known_ciks(requests: DataFrame, tickers: DataFrame) -> DataFrame:
    """resolve_cik, or an error that names tickers nobody knows."""
    absent = [r.ticker for r in unknown_tickers(requests, tickers).distinct().orderBy("ticker").limit(10).collect()]  # for the message alone
    if absent:
        raise ValueError(f"unknown tickers: {', '.join(map(str, absent))}")
    return resolve_cik(requests, tickers)


def resolve_cik(requests: DataFrame, tickers: DataFrame) -> DataFrame:
    """requests (ticker) with the 10-digit cik, null where unknown; unknown_tickers() gives those."""
    t = tickers.select(F.upper(F.trim("ticker")).alias("__t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return requests.join(t, F.upper(F.trim("ticker")) == F.col("__t"), "left").drop("__t")


def unknown_tickers(requests: DataFrame, tickers: DataFrame) -> DataFrame:
    return resolve_cik(requests, tickers).where("cik is null").select("ticker")


def label_companies(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """rows (cik) with a ticker, or CIK and the number where there is none."""
    t = tickers.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("__c"), F.col("ticker").alias("__t"))
    return rows.join(t, F.col("cik") == F.col("__c"), "left").withColumn("label", F.coalesce("__t", F.concat(F.lit("CIK"), "cik"))).drop("__c", "__t")


def landing_latest(landed: DataFrame, now: float, ttl: float | None) -> DataFrame:
    """The newest fresh entry per key of a landing table (key, fetched_at, data); no ttl: entries don't expire.  Of entries fetched at the same time the one with the largest data counts."""
    fresh = landed if ttl is None else landed.where(F.col("fetched_at").isNotNull() & (F.lit(now) - F.col("fetched_at") < ttl))
    return fresh.groupBy("key").agg(F.max(F.struct("fetched_at", "data")).alias("x")).select("key", "x.fetched_at", "x.data")


class _Leaves(HTMLParser):
    """Texts of block elements that hold no block; an open p ends where a block begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, has a block inside, pieces]
        self.out: list[str] = []
        self.skip = 0

    def _close(self) -> None:
        tag, inner, pieces = self.open.pop()
        text = " ".join(pieces)
        if not inner and text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in BLOCKS:
            if self.open and self.open[-1][0] == "p":
                self._close()
            if self.open:
                self.open[-1][1] = True
            self.open.append([tag, False, []])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in BLOCKS and any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        piece = data.strip()
        if piece and self.open and not self.skip:
            self.open[-1][2].append(piece)

    def close(self):
        super().close()
        while self.open:
            self._close()


def leaf_blocks(html: str | None) -> list[str]:
    parser = _Leaves()
    parser.feed(html or "")
    parser.close()
    return parser.out


def paragraph_lists(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, lines: the leaf blocks of each page in order (HTML needs a parser: one Arrow map, no shuffle)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([leaf_blocks(h) for h in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=[key, "lines"])

    kind = dict(pages.dtypes)[key]
    ship(pages.sparkSession)
    return pages.select(key, html).mapInArrow(scan, f"`{key}` {kind}, lines array<string>")


def paragraphs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, text of all leaf blocks."""
    return paragraph_lists(pages, key, html).select(key, F.posexplode("lines").alias("pos", "text"))


def headings(lines: Column, pattern: str) -> Column:
    """(start, stop) wherever one to three lines together hold a heading that begins in the first; the shortest window wins."""

    def span(text, at):
        second, third = F.get(lines, at + 1), F.get(lines, at + 2)
        begins = lambda t: t.rlike(pattern) & (F.regexp_instr(t, F.lit(pattern)) - 1 <= F.length(text))
        two, three = F.concat_ws(" ", text, second), F.concat_ws(" ", text, second, third)
        n = F.when(begins(text), 1).when(second.isNotNull() & begins(two), 2).when(third.isNotNull() & begins(three), 3)
        return F.struct(at.alias("start"), (at + n).alias("stop"))

    return F.filter(F.transform(lines, span), lambda x: x["stop"].isNotNull())


def locate(lines: Column, form: str) -> Column:
    """(b, e, error): the section is lines b to e - 1; without one, b and e are null and the error says why.

    Each start pairs with the first end after it; the longest pair wins, the first on ties.
    """
    if form not in SECTIONS:
        raise ValueError(f"no section is known for form {form}")
    start, ends = SECTIONS[form]
    stops = F.transform(headings(lines, start), lambda x: x["stop"])
    tails = F.concat(*[F.transform(headings(lines, p), lambda x: x["start"]) for p in ends])

    def best(stops, tails):
        pair = lambda b: F.struct((F.array_min(F.filter(tails, lambda e: e >= b)) - b).alias("gap"), (-b).alias("first"))
        x = F.array_max(F.filter(F.transform(stops, pair), lambda p: p["gap"].isNotNull()))
        error = F.when(F.coalesce(F.size(stops), F.lit(0)) <= 0, NO_START).when(F.size(tails) == 0, NO_END).when(x.isNull(), NO_PAIR)
        return F.struct((-x["first"]).alias("b"), (x["gap"] - x["first"]).alias("e"), error.alias("error"))

    once = F.array(F.struct(stops.alias("stops"), tails.alias("tails")))  # a list of one: both are looked for once
    return F.transform(once, lambda x: best(x["stops"], x["tails"]))[0]


def sections(lines: DataFrame, key: str, form: str) -> DataFrame:
    """The body lines (key, pos, text) of each key's section; one shuffle brings a key's lines together."""
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("__lines"))
    found = whole.withColumn("__at", locate(F.transform("__lines", lambda x: x["text"]), form))
    body = F.slice("__lines", F.col("__at.b") + 1, F.col("__at.e") - F.col("__at.b"))
    return found.select(key, F.explode(body).alias("__x")).select(key, "__x.pos", "__x.text")


def chunks(lines: DataFrame, key: str, least: int = MIN_CHUNK) -> DataFrame:
    """Lines of `least` characters or more, numbered anew from 0."""
    order = Window.partitionBy(key).orderBy("pos")
    return lines.where(F.length("text") >= least).select(key, (F.row_number().over(order) - 1).alias("chunk_index"), "text")


def get_section(filings: DataFrame, key: str, form: str) -> DataFrame:
    """key, chunk_index, text, error: the chunks of each filing's section, no row if all its lines are short, one row with the cause
    where there is no section.  No shuffle: a filing is parsed once and its section is cut out of its own lines."""
    at = paragraph_lists(filings, key).withColumn("__at", locate(F.col("lines"), form))
    body = F.slice("lines", F.col("__at.b") + 1, F.col("__at.e") - F.col("__at.b"))
    kept = F.transform(F.filter(body, lambda t: F.length(t) >= MIN_CHUNK), lambda t, i: F.struct(i.alias("chunk_index"), t.alias("text")))
    failed = F.array(F.struct(F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("text")))
    rows = at.select(key, F.explode(F.when(F.col("__at.error").isNull(), kept).otherwise(failed)).alias("__x"), F.col("__at.error").alias("error"))
    return rows.select(key, "__x.chunk_index", "__x.text", "error")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)
