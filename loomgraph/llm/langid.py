"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: the likelihood of the visible text (naive Bayes
over hashed character n-grams), the language the markup declares, what an address names
(a language in a sub-domain or path, else any two-letter suffix), and a prior of the
page's host. A language is the first part of its tag, whole ("pt" of "pt-BR"). Host
priors are smoothed in levels, host to domain to all pages, and all counts come from
grouped aggregation over a first reading of every page by its text alone; so do the
confusion tables that say how far a declared language is to be trusted.
"""

from __future__ import annotations

import html as html_entities
import re
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_often, map_text, text_or_empty

#: Hashed n-gram columns; training documents of each language at most; letters of a text
#: whose n-grams count in full (longer texts count all of theirs at this total weight).
DIMENSIONS, SAMPLE, WEIGHT = 1 << 16, 2_000, 60.0
#: Pseudo-counts with which a level's shares enter the level below.
STRENGTH = 8.0

_ASIDE = re.compile(r"<(script|style|noscript|template)\b", re.I)
_CLOSED = {x: re.compile(rf"</{x}\s*+>", re.I) for x in ("script", "style", "noscript", "template")}
_HEAD_TAG = re.compile(r"<(html|meta)\b", re.I)
_BODY = re.compile("<body", re.I)
_LANG = re.compile(r"(?<![\w-])lang\s*+=\s*+(?:[\"']\s*+)?([a-zA-Z]{2,8})(?![a-zA-Z])", re.I)
_META = re.compile(r"(?:http-equiv\s*+=\s*+[\"']?content-language|property\s*+=\s*+[\"']?og:locale|name\s*+=\s*+[\"']?language)(?![\w-])", re.I)
_CONTENT = re.compile(r"(?<![\w-])content\s*+=\s*+(?:[\"']\s*+)?([a-zA-Z]{2,8})(?![a-zA-Z])", re.I)
_PATH_LANG = re.compile(r"(?:^|[/.?&=])([a-z]{2})(?=$|[/.?&#]|[-_][A-Za-z]{2}\b)")
_LETTERS = re.compile(r"[^\W\d_]+")


def visible_text(page: str) -> str:
    """Text of a page without scripts, styles, comments and tags, each of which leaves a space.

    One pass from left to right: what is not closed is looked for once, so that a page of
    openings costs no more than another. An opening bracket that nothing closes is text."""
    out, at, without = [], 0, set()

    def after(name: str, find) -> int | None:
        """Where the part that begins here ends, or None; the search isn't repeated after it failed."""
        if name in without:
            return None
        end = find()
        if end is None:
            without.add(name)
        return end

    def closing(name: str, start: int) -> int | None:
        m = _CLOSED[name].search(page, start)
        return m.end() if m else None

    def following(mark: str, start: int) -> int | None:
        k = page.find(mark, start)
        return None if k < 0 else k + len(mark)

    while (i := page.find("<", at)) >= 0:
        out.append(page[at:i])
        end = None
        if page.startswith("<!--", i):
            end = after("comment", lambda: following("-->", i + 4))  # noqa: B023
        elif m := _ASIDE.match(page, i):
            name = m[1].lower()
            end = after(name, lambda: closing(name, i))  # noqa: B023
        if end is None:
            end = following(">", i + 1)
        if end is None:
            at = i
            break
        out.append(" ")
        at = end
    out.append(page[at:])
    return html_entities.unescape("".join(out))


def declared_language(page: str) -> str | None:
    """First part of the language of the html tag, else of a meta tag, before the body; one pass."""
    m, at, by_meta = _BODY.search(page), 0, None
    head = page[: m.start()] if m and m.start() else page
    while tag := _HEAD_TAG.search(head, at):
        at = head.find(">", tag.end())
        if at < 0:
            break
        inside = head[tag.end() : at]
        if tag[1].lower() == "html":
            if found := _LANG.search(inside):
                return found[1].lower()
        elif by_meta is None and _META.search(inside) and (found := _CONTENT.search(inside)):
            by_meta = found[1].lower()
    return by_meta


def address_parts(url: str) -> tuple[str, str, list[str], str | None]:
    """(host, domain, two-letter codes of sub-domain, path and query, two-letter suffix), all in lower case."""
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host = (parts.hostname or "").lower().rstrip(".")
    except ValueError:
        return "", "", [], None
    labels = host.split(".")
    domain = ".".join(labels[-2:])
    codes = [x for x in labels[:-2] if len(x) == 2]
    codes += _PATH_LANG.findall((parts.path + ("?" + parts.query if parts.query else "")).lower())
    suffix = labels[-1] if len(labels) > 1 and len(labels[-1]) == 2 and labels[-1].isalpha() else None
    return host, domain, codes, suffix


def gram_numbers(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and counts of the 1- to 4-letter grams of a text's words, with word ends."""
    joined = " " + " ".join(_LETTERS.findall(text.lower())) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    grams, h = [], np.zeros(len(c), dtype=np.uint64)
    for n in range(1, 5):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[n - 1 :] + np.uint64(n))
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        grams.append(mixed >> np.uint64(40))
    numbers, counts = np.unique(np.concatenate(grams) % np.uint64(dimensions), return_counts=True)
    return numbers.astype(np.int64), counts


def train_text(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages, log P(gram | language)) from at most `sample` documents of each language.

    The counts are summed in partitions before they are grouped; the driver gets one
    row for each gram number and language. A `lang` that is null or does not begin with a tag
    of two or three letters is left out, and so are a null id's rows; null and empty texts and
    repeated rows count as they are, a very long text with a bounded weight. Without usable
    rows there are no languages."""
    tag = F.lower(F.regexp_extract(F.col("lang").cast("string"), r"^\s*([A-Za-z]{2,3})(?![A-Za-z0-9])", 1))
    named = docs.select(tag.alias("lang"), "doc_id", text_or_empty().alias("text")).where("lang != ''")
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    unit = F.xxhash64("doc_id", F.lit("lang")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (unit < min(1.0, sample / n)))
    langs = sorted(sizes)
    place = {x: i for i, x in enumerate(langs)}
    chosen = named.where(keep).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        counts = np.zeros((len(langs), dimensions))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers, n = gram_numbers(text, dimensions)
                counts[place[lang], numbers] += n * min(1.0, 4000.0 / max(1, n.sum()))
        row, col = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(counts[row, col])], names=["lang", "gram", "n"]
        )

    got = chosen.mapInArrow(run, "lang int, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((max(1, len(langs)), dimensions), 0.1)
    table[got["lang"].to_numpy(int), got["gram"].to_numpy(int)] += got["n"].to_numpy(float)
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def read_pages(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, domain, declared, address, loglik, first: the evidence of each page.

    loglik is the text's log-likelihood by language (zeros for a text without letters);
    first the language it names by itself, null where it has none; declared is null unless it
    names one of `langs`; address is the first code among these, else the suffix with its dot."""
    sent = pages.sparkSession.sparkContext.broadcast((langs, table.astype(np.float32)))

    def run(rows: list) -> dict[str, list]:
        langs, table = sent.value
        known, out = set(langs), {k: [] for k in ("host", "domain", "declared", "address", "loglik", "first")}
        for row in rows:
            url, page = row["url"] or "", row["html"] or ""
            host, domain, codes, suffix = address_parts(url)
            declared = declared_language(page)
            text = visible_text(page)
            numbers, counts = gram_numbers(text, table.shape[1])
            has = bool(_LETTERS.search(text))
            ll = np.zeros(len(langs))
            if has and langs:
                ll = table[:, numbers].astype(np.float64) @ counts
                ll *= min(1.0, WEIGHT / counts.sum())
                ll -= ll.max()
            out["host"].append(host)
            out["domain"].append(domain)
            out["declared"].append(declared if declared in known else None)
            out["address"].append(next((x for x in codes if x in known), "." + suffix if suffix else None))
            out["loglik"].append(ll.tolist())
            out["first"].append(langs[int(ll.argmax())] if has and langs else None)
        return out

    source = pages.select("page_id", F.struct(text_or_empty("url").alias("url"), text_or_empty("html").alias("html")).alias("page"))
    return map_text(source, run, "host string, domain string, declared string, address string, loglik array<double>, first string", rows=500)


def confusion(seen: DataFrame, column: str, langs: list[str]) -> DataFrame:
    """`column`, logs: log P(column = d | language) by language, in their order, for each d that occurs,
    from the first reading, with pseudo-counts: 6 where d names the language (a suffix, too), else 1.

    At most as many rows as there are languages and two-letter suffixes."""
    rows = seen.where(F.col(column).isNotNull() & F.col("first").isNotNull()).groupBy(column, "first").count().collect()
    n = {(r[column], r["first"]): r["count"] for r in rows}
    values = sorted({*langs, *(d for d, _ in n), *(r[column] for r in seen.where(F.col(column).isNotNull()).select(column).distinct().collect())})
    logs = []
    for d in values:
        each = []
        for x in langs:
            total = sum(n.get((v, x), 0) + (6.0 if v.lstrip(".") == x else 1.0) for v in values)
            each.append(float(np.log((n.get((d, x), 0) + (6.0 if d.lstrip(".") == x else 1.0)) / total)))
        logs.append((d, each))
    return seen.sparkSession.createDataFrame(logs, f"{column} string, logs array<double>")


def host_priors(seen: DataFrame, langs: list[str], strength: float = STRENGTH) -> DataFrame:
    """host, domain, rows, prior: pages, and log-shares by language in the order of `langs`, smoothed
    host to domain to all pages to even shares. One row for each host; counts are grouped, so a
    host with very many pages is pre-aggregated where its pages lie."""
    counted = [F.count(F.when(F.col("first") == x, 1)).cast("double").alias(f"n{i}") for i, x in enumerate(langs)]
    hosts = seen.groupBy("domain", "host").agg(F.count(F.lit(1)).alias("rows"), *counted)
    sums = [F.sum(f"n{i}").alias(f"d{i}") for i in range(len(langs))]
    domains = hosts.groupBy("domain").agg(*sums)
    whole = domains.agg(*[F.sum(f"d{i}").alias(f"s{i}") for i in range(len(langs))]).first()
    totals = [float(whole[f"s{i}"] or 0.0) for i in range(len(langs))]
    top = [(n + strength / len(langs)) / (sum(totals) + strength) for n in totals]

    def mixed(prefix: str, above: list) -> list:
        total = sum((F.col(f"{prefix}{i}") for i in range(len(langs))), F.lit(0.0)) + strength
        return [(F.col(f"{prefix}{i}") + strength * above[i]) / total for i in range(len(langs))]

    domains = domains.select("domain", *[p.alias(f"p{i}") for i, p in enumerate(mixed("d", [F.lit(p) for p in top]))])
    joined = hosts.join(domains, "domain")
    shares = mixed("n", [F.col(f"p{i}") for i in range(len(langs))])
    return joined.select("host", "domain", "rows", F.array(*[F.log(p) for p in shares]).alias("prior"))


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang, confidence, lang_text, lang_declared, lang_address, host.

    One row per row of `pages`. Null or empty url or html is missing evidence: the rest
    decides, and with none at all the shares of all pages do. lang is the likeliest
    language (ties: first in alphabetical order), confidence its posterior. With no
    training languages lang is null and confidence 0. Very long pages are read whole, in one
    pass; repeated rows stay; other columns are not read; no pages give no rows. A host
    with very many pages is joined without being dealt by its name.
    """
    langs, table = train_text(docs, sample)
    if not langs:
        read = read_pages(pages, langs, table)
        none = F.lit(None).cast("string")
        return read.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("lang_text"), none.alias("lang_declared"), none.alias("lang_address"), "host")
    seen = cut(read_pages(pages, langs, table), "pages-read")
    priors = cut(host_priors(seen, langs).drop("domain"), "host-priors")
    found = join_often(seen, priors, "host")
    sums = F.zip_with("loglik", "prior", lambda a, b: a + b)
    for c in ("declared", "address"):
        logs = confusion(seen, c, langs).withColumnRenamed("logs", f"{c}_logs")
        found = found.join(F.broadcast(logs), c, "left")  # a row for each language and suffix
        sums = F.zip_with(sums, F.coalesce(f"{c}_logs", F.array(*[F.lit(0.0)] * len(langs))), lambda a, b: a + b)
    scored = found.withColumn("logs", sums).withColumn("best", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("best")))
    return scored.select(
        "page_id", F.element_at(F.array(*map(F.lit, langs)), F.array_position("logs", F.col("best")).cast("int")).alias("lang"),
        (1 / mass).alias("confidence"), F.col("first").alias("lang_text"), F.col("declared").alias("lang_declared"), F.col("address").alias("lang_address"), "host",
    )
