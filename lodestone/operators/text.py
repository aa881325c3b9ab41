"""Full-text search: tokens, postings, BM25 with fields, phrases, prefixes and typos, highlights."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import Refused

K1, B = 1.2, 0.75
LIMIT, MOST_LIMIT = 10, 1000
#: Han with extension A, kana, hangul and compatibility ideographs: scripts that are cut into pairs.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
_RUN = rf"([{CJK}]+|[[\p{{IsAlphabetic}}\p{{N}}]&&[^{CJK}]]+)"


def tokens(text: Column) -> Column:
    """Words of two or more letters or digits in lower case; CJK runs as overlapping pairs, a lone character as itself."""
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(1))
    pairs = lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    one = lambda r: F.when(r.rlike(f"^[{CJK}]"), pairs(r)).when(F.char_length(r) >= 2, F.array(F.lower(r))).otherwise(F.array().cast("array<string>"))
    # texts without such scripts need no look at each run
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]{2,}"), F.lit(0)), F.lower)
    return F.when(text.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, one))).otherwise(plain)


def postings(df: DataFrame, fields: tuple[str, ...], key: str = "key", cut: Tokenizer | None = None) -> DataFrame:
    """(key, field, pos, term): one row per token. Write it as Parquet to search it again and again."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (cut or WORDS).column(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields]))
    return df.select(F.col(key).alias("key"), each.alias("f")).select("key", F.col("f.field").alias("field"), F.posexplode("f.t").alias("pos", "term"))


@dataclass(frozen=True)
class Query:
    """Clauses of a MATCH: bare terms, phrases and prefixes, all ORed in score; phrases must be there."""

    terms: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    prefixes: tuple[str, ...] = ()


_CJK_PY = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]+")


def query_tokens(text: str) -> list[str]:
    """tokens() of a query, on the driver."""
    out = []
    for run in re.findall(rf"{_CJK_PY.pattern}|[^\W_]+", text):
        for part in re.findall(rf"{_CJK_PY.pattern}|[^{_CJK_PY.pattern[1:-2]}]+", run):
            if _CJK_PY.match(part):
                out += [part] if len(part) == 1 else [part[i : i + 2] for i in range(len(part) - 1)]
            elif len(part) >= 2:
                out.append(part.lower())
    return out


@dataclass(frozen=True)
class Tokenizer:
    """How texts are cut: the terms of a column, and of a query on the driver. Both must cut alike."""

    column: Callable[[Column], Column]
    query: Callable[[str], list[str]]


WORDS = Tokenizer(tokens, query_tokens)


def parse(text: str, positions: bool = True, cut: Tokenizer = WORDS) -> Query:
    """"quoted phrases", prefix* and bare terms."""
    phrases, prefixes, terms = [], [], []
    for m in re.finditer(r'"([^"]*)"|(\S+)\*(?=\s|$)|(\S+)', text):
        if m[1] is not None:
            got = tuple(cut.query(m[1]))
            if len(got) > 1:
                if not positions:
                    raise Refused("a phrase needs WITH POSITIONS")
                phrases.append(got)
            else:
                terms += got
        elif m[2]:
            prefixes.append(re.sub(r"[A-Z]", lambda c: c[0].lower(), m[2]))
        else:
            terms += cut.query(m[3])
    return Query(tuple(sorted(set(terms))), tuple(dict.fromkeys(phrases)), tuple(dict.fromkeys(prefixes)))


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def near(term: Column, word: str, typo: int) -> Column:
    """Whether a term is within `typo` edits of a word; edits count bytes, so a letter beyond ASCII may take several."""
    single = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(single(term), single(F.lit(word)), typo) >= 0


def expand(post: DataFrame, query: Query, typo: int = 0) -> DataFrame:
    """(term): dictionary terms that the query's terms, phrases and prefixes stand for."""
    if not 0 <= typo <= 2:
        raise Refused("TYPO is 0, 1 or 2")
    exact = sorted({*query.terms, *(t for p in query.phrases for t in p)})
    test = F.col("term").isin(*exact) if exact else F.lit(False)
    for p in query.prefixes:
        test |= F.col("term").startswith(p)
    if typo:
        for t in query.terms:
            test |= near(F.col("term"), t, typo)
    return post.select("term").where(test).distinct()


def match(post: DataFrame, text: str, fields: tuple[str, ...] = (), weights: dict[str, float] | None = None, typo: int = 0, cut: Tokenizer = WORDS) -> DataFrame:
    """(key, score) of every match of a query in postings.

    fields: score within these only (lengths, frequencies, averages; the number of documents stays). weights:
    of fields; a term's weighted frequency is rounded up, lengths stay unweighted. Documents without a
    token count nowhere. One aggregate for the statistics and one for the matches; only matched terms are
    grouped by document.
    """
    query = parse(text, cut=cut)
    n = post.agg(F.countDistinct("key").alias("n"))
    scope = post.where(F.col("field").isin(*fields)) if fields else post
    lengths = scope.groupBy("key").agg(F.count("*").alias("dl"))
    stats = lengths.agg(F.avg("dl").alias("avgdl")).crossJoin(F.broadcast(n))  # one row each
    wanted = expand(scope, query, typo)
    weight = F.lit(1.0)
    for f, w in (weights or {}).items():
        weight = F.when(F.col("field") == f, F.lit(float(w))).otherwise(weight)
    by_field = scope.join(wanted, "term", "left_semi").groupBy("key", "field", "term").agg(F.count("*").alias("tf"))
    tf = by_field.groupBy("key", "term").agg(F.sum(F.greatest(F.ceil(F.col("tf") * weight), F.lit(1))).alias("tf"))
    frequency = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(frequency, "term").join(lengths, "key").crossJoin(F.broadcast(stats))
    score = bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))
    # terms add up in their order, so that no partitioning changes the last digits
    out = scored.groupBy("key").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("term", score.alias("s")))), F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))
    for phrase in query.phrases:
        out = out.join(with_phrase(scope, phrase), "key", "left_semi")
    return out


def match_texts(df: DataFrame, text: str, fields: tuple[str, ...], within: tuple[str, ...] = (), weights: dict[str, float] | None = None, typo: int = 0, key: str = "key", cut: Tokenizer = WORDS) -> DataFrame:
    """match() straight from texts: (key, score) of every match, without postings.

    Tokens stay arrays in their row; only those that match are exploded. `within` narrows the score to some of the
    fields. One scan for the statistics (a single row) and one for the matches.
    """
    query = parse(text, cut=cut)
    exact = sorted({*query.terms, *(t for p in query.phrases for t in p)})

    def wanted(t: Column) -> Column:
        test = t.isin(*exact) if exact else F.lit(False)
        for p in query.prefixes:
            test |= t.startswith(p)
        if typo:
            for x in query.terms:
                test |= near(t, x, typo)
        return test

    if not 0 <= typo <= 2:
        raise Refused("TYPO is 0, 1 or 2")
    scope = [i for i, f in enumerate(fields) if f in (within or fields)]
    # the one-element explode makes Spark compute the tokens of a row once
    each = F.explode(F.array(F.struct(*[cut.column(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)]))).alias("x")
    rows = df.select(F.col(key).alias("key"), each)
    dl = sum((F.size(f"x.t{i}") for i in scope), F.lit(0))
    every = sum((F.size(f"x.t{i}") for i in range(len(fields))), F.lit(0))
    stats = rows.agg(F.count_if(every > 0).alias("n"), F.avg(F.when(dl > 0, dl)).alias("avgdl"))
    fits = F.lit(True)
    for p in query.phrases:
        here = F.lit(False)
        for i in scope:
            here |= _adjacent(F.col(f"x.t{i}"), p)
        fits &= here
    hits = F.concat(*[_tagged(F.filter(f"x.t{i}", wanted), fields[i]) for i in scope])
    found = rows.where(fits).select("key", dl.alias("dl"), F.explode(hits).alias("h"))
    weight = F.lit(1.0)
    for f, w in (weights or {}).items():
        weight = F.when(F.col("field") == f, F.lit(float(w))).otherwise(weight)
    by_field = found.groupBy("key", "dl", F.col("h.field").alias("field"), F.col("h.term").alias("term")).agg(F.count("*").alias("tf"))
    tf = by_field.groupBy("key", "dl", "term").agg(F.sum(F.greatest(F.ceil(F.col("tf") * weight), F.lit(1))).alias("tf"))
    if query.phrases:  # documents without the phrase count in a term's frequency too
        seen = rows.select("key", F.explode(F.array_distinct(F.transform(hits, lambda h: h["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    else:
        seen = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(seen, "term").crossJoin(F.broadcast(stats))
    score = bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("key").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("term", score.alias("s")))), F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))


def claused(matched: DataFrame, df: DataFrame, filters: Column | None = None, sort: tuple[str, bool] | None = None, distinct: str | None = None, limit: int = LIMIT, offset: int = 0, key: str = "key") -> DataFrame:
    """A page of matches with their rows: filtered, sorted by a column (missing last) or by score, one row a value of `distinct`."""
    rows = df.join(matched, key)
    rows = rows if filters is None else rows.where(filters)
    order = [F.desc("score"), F.col(key)]
    if sort:
        order = [F.col(sort[0]).desc_nulls_last() if sort[1] else F.col(sort[0]).asc_nulls_last(), F.col(key)]
    if distinct:
        seat = F.row_number().over(Window.partitionBy(distinct, F.when(F.col(distinct).isNull(), F.col(key))).orderBy(*order))
        rows = rows.withColumn("_seat", seat).where(F.col("_seat") == 1).drop("_seat")
    rows = rows.orderBy(*order)
    return (rows.offset(offset) if offset else rows).limit(max(1, min(limit, MOST_LIMIT)))


def _tagged(terms: Column, field: str) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))


def _adjacent(t: Column, phrase: tuple[str, ...]) -> Column:
    want = F.array(*map(F.lit, phrase))
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - len(phrase) + 1, F.lit(1))), lambda i: F.slice(t, i, len(phrase)) == want)


def with_phrase(post: DataFrame, phrase: tuple[str, ...]) -> DataFrame:
    """(key) of documents with the tokens next to each other and in order, in one field: one grouping, no self-joins."""
    ranks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(phrase)])
    hits = post.where(F.col("term").isin(*set(phrase))).withColumn("r", F.explode(F.filter(ranks, lambda x: x["t"] == F.col("term"))))
    runs = hits.groupBy("key", "field", (F.col("pos") - F.col("r.i")).alias("start")).agg(F.countDistinct("r.i").alias("n"))
    return runs.where(F.col("n") == len(phrase)).select("key").distinct()


def top(matched: DataFrame, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    out = matched.orderBy(F.desc("score"), "key")
    return (out.offset(offset) if offset else out).limit(max(1, min(limit, MOST_LIMIT)))


def highlight(df: DataFrame, text: str, fields: tuple[str, ...], typo: int = 0, key: str = "key") -> DataFrame:
    """(key, field, spans): byte ranges [lo, hi) of matched words in each field; of phrases, adjacent runs only.

    Runs of scripts that are cut into pairs are marked whole. Only texts with a matching word are taken apart.
    """
    query = parse(text)

    def bare(t: Column) -> Column:
        test = t.isin(*query.terms) if query.terms else F.lit(False)
        for p in query.prefixes:
            test |= t.startswith(p)
        if typo:
            for x in query.terms:
                test |= near(t, x, typo)
        return test

    word = rf"[{CJK}]+|[[\p{{IsAlphabetic}}\p{{N}}]&&[^{CJK}]]+"
    phrased = sorted({t for p in query.phrases for t in p})
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("s")) for f in fields]))
    rows = df.select(F.col(key).alias("key"), each.alias("f")).select("key", "f.field", "f.s")
    rows = rows.where(F.exists(F.transform(F.regexp_extract_all("s", F.lit(f"({word})"), F.lit(1)), F.lower), lambda t: bare(t) | (t.isin(*phrased) if phrased else F.lit(False))))
    # what lies between words, and words: byte offsets are running lengths
    both = F.arrays_zip(F.split("s", word).alias("g"), F.regexp_extract_all("s", F.lit(f"({word})"), F.lit(1)).alias("w"))
    rows = rows.select("key", "field", F.posexplode(both).alias("pos", "x")).where("x.w is not null")
    order = Window.partitionBy("key", "field").orderBy("pos")
    hi = F.sum(F.octet_length("x.g") + F.octet_length("x.w")).over(order)
    rows = rows.select("key", "field", "pos", hi.alias("hi"), (hi - F.octet_length("x.w")).alias("lo"), F.lower("x.w").alias("t")).where(F.char_length("t") >= 2)
    rows = rows.withColumn("pos", F.row_number().over(order))
    marks = rows.where(bare(F.col("t"))).select("key", "field", "lo", "hi")
    for phrase in query.phrases:
        ranks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(phrase)])
        hits = rows.where(F.col("t").isin(*set(phrase))).withColumn("r", F.explode(F.filter(ranks, lambda x: x["t"] == F.col("t"))))
        runs = hits.groupBy("key", "field", (F.col("pos") - F.col("r.i")).alias("start")).agg(F.countDistinct("r.i").alias("n"), F.collect_list(F.struct("lo", "hi")).alias("in"))
        marks = marks.unionByName(runs.where(F.col("n") == len(phrase)).select("key", "field", F.inline("in")))
    return marks.distinct().groupBy("key", "field").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
