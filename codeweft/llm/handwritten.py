"""Problem 1: source files that were not written by hand for the repository.

A random forest is trained on files whose header notices say that a tool made them or that they come from elsewhere,
against files without a notice in ordinary places that are not mostly literal data; header and notices are cut off before the features are taken, so the forest never sees
what it is labelled by. Its features are the form of the code (compression ratio, entropy of tokens, lengths of
identifiers, density of comments, share of literal data and the like) and two of its place: whether it is where made
files are, and whether it is where foreign files are or how much of it is in a known third-party file. The known files
are labelled too. Most files that are not hand-written bear no notice and lie among the negatives and the files that
have no label, so the forest trains itself in rounds: files it finds likely become positive, negatives it doubts are
left out, until the last round decides. A notice is a label and stands; every other file is decided by the forest. Features are one narrow Python
stage; the forest is Spark ML on a bounded sample of labelled rows; likeness is a join of token shingles.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.syntax import language_of
from codeweft.session import spread, staged

CODE = ("python", "javascript", "typescript", "go", "rust")
#: Rows that the forest sees, of each label at most, besides the known files.
SAMPLE = 10_000
TREES, TREE_DEPTH, LIKELY, DOUBTED = 60, 8, 0.5, 0.25
#: Rounds of self-training, tokens of a shingle, share of literal data from which a file is no negative.
ROUNDS, SHINGLE, DATA = 3, 5, 0.8
#: Shingles that a file is taken to have besides its own, none of them shared, so that few shared ones prove little.
PRIOR = 4
#: Known shingles up to which they are broadcast, 8 bytes each; beyond it all shingles are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

# How notices of tools and of foreign origin begin (labels only), where foreign and made files are kept, how they are named.
TOOL = re.compile(
    r"code generated by|@generated\b|auto-?generated (?:file|by|from|code)|automatically (?:produced|generated|created)|generated (?:from|by) \S+.*(?:overwrit|do not|edit|\.(?:proto|idl|yaml|yml|schema|json|xml|thrift|graphql))"
    r"|do not (?:modify|edit)\b.*re-?generate|regenerate with|fichier (?:produit|g[ée]n[ée]r[ée]) par|automatisch (?:erzeugt|generiert)|(?:generado|generato) (?:autom\w+ )?(?:por|da|a partir)",
    re.I,
)
FOREIGN = re.compile(r"copied from \S+ v?\d|send fixes upstream|taken over (?:unchanged )?from|taken over unchanged|released under the .{1,40} licen[sc]e by the \S+ project|\|\s*\(c\) \d{4} .* contributors|vendored from|this file is part of \S+ v?\d", re.I)
BANNER = re.compile(r"\A\s*/\*![^\n]{0,200}\bv?\d+\.\d+|//[#@] ?sourceMappingURL=")
FOREIGN_PLACE = r"(?:^|/)(?:vendor|third_party|third-party|thirdparty|node_modules|external|deps|bower_components|site-packages|Godeps)/"
MADE_PLACE = r"(?:^|/)(?:dist|gen|generated)/|(?:\.min|[._]pb|_pb2|_pb2_grpc|\.gen|\.generated|_generated|\.bundle)\.(?:py|ts|js|go|rs)$"

WORDS = re.compile(r"\d+|[^\W\d]\w*")
COMMENT_LINE = re.compile(r"\s*(?://|#(?!!?\[)|/?\*|\"\"\"|'''|<!--|--)")
PIECE = re.compile(
    r"(?P<com>/\*.*?(?:\*/|\Z)|//[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|(?P<hash>\#[^\n]*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)"
    r"|(?P<num>\b(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?))|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>[^\w\s])",
    re.S,
)
FEATURES = ("compression", "token_entropy", "char_entropy", "identifier_mean", "identifier_sd", "identifier_short", "distinct_tokens", "comment_share", "comment_lines", "line_mean", "line_max", "space_share", "literal_share", "line_likeness", "digits", "data_share", "size")
PARTS = "struct<blank:boolean,tool:boolean,foreign:boolean,banner:boolean,features:array<double>,n:bigint,shingles:array<bigint>>"


def entropy(counts: Counter) -> float:
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0


def without_notices(text: str) -> tuple[str, bool, bool]:
    """The text without its leading comments and any notices, and what the notices say."""
    tool = foreign = False
    kept, header = [], True
    for line in text.split("\n"):
        comment = bool(COMMENT_LINE.match(line))
        said = comment and TOOL.search(line), comment and FOREIGN.search(line)
        tool, foreign = tool or bool(said[0]), foreign or bool(said[1])
        header = header and (comment or not line.strip())
        if not header and not any(said):
            kept.append(line)
        elif header and comment and "*/" in line and line.split("*/", 1)[1].strip():
            kept.append(line.split("*/", 1)[1])
            header = False
    return "\n".join(kept), tool, foreign


def shingle_hashes(tokens: list[str]) -> np.ndarray:
    """Distinct 64-bit hashes of SHINGLE tokens in succession; shorter texts are one shingle."""
    if not tokens:
        return np.zeros(0, np.int64)
    known = {t: zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in set(tokens)}
    h = np.array([known[t] for t in tokens], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def parts(text: str | None, language: str | None) -> tuple:
    body, tool, foreign = without_notices(text or "")
    ids: list[int] = []
    named: list[str] = []
    words: list[str] = []
    literal = code = comment = data = 0
    for m in PIECE.finditer(body):
        kind, w = m.lastgroup, m.group()
        if kind == "hash":
            if language != "python":
                words.append("#")
                continue
            kind = "com"
        if kind == "com":
            comment += len(w)
            continue
        size = len(w)
        code += size
        if kind == "id":
            ids.append(size)
            named.append(w)
        elif kind == "op":
            named.append(w)
            data += w in ",[]{}()-;:"
        else:
            literal += size
            named.append(kind)
        words.append(w)
    tokens, data = Counter(named), data + literal
    lines = body.split("\n")
    shapes = Counter(y for x in WORDS.sub("w", body).split("\n") if (y := x.strip()))
    chars = Counter(body)
    spaces, digits = (sum(n for c, n in chars.items() if is_kind(c)) for is_kind in (str.isspace, str.isdigit))
    raw, n = body.encode("utf-8", "surrogatepass"), max(1, len(body))
    mean = sum(ids) / len(ids) if ids else 0.0
    features = [
        len(zlib.compress(raw, 6)) / max(1, len(raw)), entropy(tokens), entropy(chars), mean, (sum((x - mean) ** 2 for x in ids) / len(ids)) ** 0.5 if ids else 0.0,
        sum(x <= 3 for x in ids) / len(ids) if ids else 0.0, len(tokens) / max(1, sum(tokens.values())), comment / max(1, comment + code),
        sum(bool(COMMENT_LINE.match(x)) for x in lines) / len(lines), len(body) / len(lines), float(max(map(len, lines))),
        spaces / n, literal / max(1, code), sum(c for c in shapes.values() if c > 2) / max(1, sum(shapes.values())), digits / n,
        data / max(1, code), math.log1p(code),
    ]
    return not (text or "").strip(), tool, foreign, bool(BANNER.search(text or "")), features, shingle_hashes(words)


def described(files: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """file_id, file and the parts of every code file; of the shingles only the known ones where they are given. Null contents count as empty."""
    known = files.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def describe(content: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = []
        for c, x in zip(content, language):
            *head, h = parts(c, x)
            rows.append((*head, len(h), (h if known is None else h[np.isin(h, known.value, assume_unique=True)]).tolist()))
        return pd.DataFrame(rows, columns=["blank", "tool", "foreign", "banner", "features", "n", "shingles"])

    f = files.select("file_id", "file", language_of(F.col("language"), F.col("file")).alias("language"), "content").filter(F.col("language").isin(*CODE))
    p = F.pandas_udf(describe, PARTS).asNondeterministic()(F.col("content"), F.col("language"))
    return spread(f).select("file_id", "file", p.alias("p")).select("file_id", "file", "p.*")


def known_shingles(upstream: DataFrame) -> DataFrame:
    """upstream_id, known_n and h: the shingles of the known files."""

    def shingles(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([parts(c, x)[-1].tolist() for c, x in zip(content, language)], dtype=object)

    known = upstream.select("upstream_id", F.pandas_udf(shingles, "array<bigint>")(F.col("content"), language_of(F.col("language"), F.col("file"))).alias("s"))
    return known.select("upstream_id", F.size("s").alias("known_n"), F.explode("s").alias("h"))


def likeness(d: DataFrame, known: DataFrame) -> DataFrame:
    """file_id, file and likeness: the largest share of a file's shingles, or of a known file's, that are in both."""
    own = d.select("file_id", "file", "n", F.explode("shingles").alias("h"))
    both = own.join(known, "h").groupBy("file_id", "file", "n", "upstream_id", "known_n").agg(F.count("*").alias("c"))
    return both.groupBy("file_id", "file").agg(F.max(F.col("c") / (F.least("n", "known_n") + PRIOR)).alias("likeness"))


def labelled_known(upstream: DataFrame) -> DataFrame:
    """label 1 and v of the known files: each is like itself."""
    d = described(upstream.withColumnRenamed("upstream_id", "file_id")).filter("NOT blank")
    return d.select(F.lit(1.0).alias("label"), F.concat("features", F.array(F.col("n") / (F.col("n") + PRIOR), F.lit(0.0))).alias("v"))


def evidence(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """file_id, file, notices, places, likeness and the features v of every code file; label is 1 with a notice, -1 for other files in
    foreign or made places or of literal data, which have no label, 0 for the rest, and null for blank files."""
    place = lambda rx: F.coalesce(F.col("file").rlike(rx), F.lit(False))
    known = staged(known_shingles(upstream), "known")
    small = known.count() <= BROADCAST_ROWS
    d = staged(described(files, np.unique(known.select("h").distinct().toPandas()["h"].to_numpy(np.int64)) if small else None), "described")
    like = likeness(d, F.broadcast(known) if small else known)
    on = F.col("d.file_id").eqNullSafe(F.col("l.file_id")) & F.col("d.file").eqNullSafe(F.col("l.file"))
    j = d.drop("shingles").alias("d").join(like.alias("l"), on, "left").select("d.*", F.coalesce("l.likeness", F.lit(0.0)).alias("likeness"))
    j = j.withColumn("foreign_place", place(FOREIGN_PLACE)).withColumn("made_place", place(MADE_PLACE))
    more = F.array(F.greatest(F.col("foreign_place").cast("double"), "likeness"), F.col("made_place").cast("double"))
    notice = F.col("tool") | F.col("foreign") | F.col("banner")
    open_ = F.col("foreign_place") | F.col("made_place") | (F.col("features")[FEATURES.index("data_share")] >= DATA)
    j = j.withColumn("label", F.when(F.col("blank"), None).when(notice, 1.0).when(open_, -1.0).otherwise(0.0))
    return staged(j.withColumn("v", F.concat("features", more)).drop("features"), "evidence")


def forest_of(labelled: DataFrame, seed: int = 11, rounds: int = ROUNDS):
    """A forest trained in rounds on label and v, None where a class has no rows. labelled is the bounded sample."""
    sample = staged(labelled.select("label", array_to_vector("v").alias("v")), "labelled")
    train, forest = sample.filter("label >= 0"), None
    for _ in range(rounds):
        sizes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        if len(sizes) < 2:
            break
        weight = F.when(F.col("label") == 1, sum(sizes.values()) / sizes[1.0]).otherwise(sum(sizes.values()) / sizes[0.0])
        forest = RandomForestClassifier(featuresCol="v", weightCol="weight", numTrees=TREES, maxDepth=TREE_DEPTH, minInstancesPerNode=2, seed=seed).fit(train.withColumn("weight", weight))
        made = vector_to_array("probability")[1]
        now = F.when((F.col("label") == 1) | (made >= LIKELY), 1.0).when((F.col("label") == 0) & (made < DOUBTED), 0.0)
        train = forest.transform(sample).select(now.alias("label"), "v").filter("label IS NOT NULL")
    return forest


def sampled(e: DataFrame) -> DataFrame:
    """At most SAMPLE rows of each label, chosen by hash."""
    label = e.filter("label IS NOT NULL").select("label", "v", F.xxhash64("file_id", "file").alias("o"))
    take = [label.filter(F.col("label") == x).orderBy("o").limit(SAMPLE).select("label", "v") for x in (0.0, 1.0, -1.0)]
    return take[0].unionByName(take[1]).unionByName(take[2])


def scored(e: DataFrame, forest) -> DataFrame:
    """The rows with made, the forest's probability that a file is not hand-written; 0 without a forest."""
    if forest is None:
        return e.withColumn("made", F.lit(0.0))
    e = e.withColumn("features", F.col("v"))
    return forest.transform(e.withColumn("v", array_to_vector("v"))).withColumn("made", vector_to_array("probability")[1]).select(*[c for c in e.columns if c not in ("v", "features")], "made")


def judged(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """Every code file with its evidence: tool, banner, foreign, places, likeness, made, and the verdict.

    Markdown and other languages are left out, blank files have no verdict, each row counts by itself, a null file has
    no place. The verdict is "notice" for the labelled rows and "forest" for those that the forest finds likely.
    """
    e = evidence(files, upstream)
    verdict = F.when(F.col("blank"), None).when(F.col("label") == 1, "notice").when(F.col("made") >= LIKELY, "forest")
    return scored(e, forest_of(sampled(e).unionByName(labelled_known(upstream)))).withColumn("verdict", verdict).drop("label", "n")


def held_out(files: DataFrame, upstream: DataFrame, parts: int = 5) -> DataFrame:
    """label, notice, rows and found: what a forest that is trained on the other parts finds of the part that is held out.

    The notices of the part are hidden from it; notice tells which of them a row bears. Rows of labels 0 and -1 that are
    found are no errors by themselves, as most files that are not hand-written bear no notice.
    """
    e = evidence(files, upstream).filter("label IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("file"), F.lit(parts)))
    s = scored(e.filter("part = 0"), forest_of(sampled(e.filter("part > 0")).unionByName(labelled_known(upstream))))
    notice = F.when(F.col("tool"), "tool").when(F.col("banner"), "banner").when(F.col("foreign"), "foreign").otherwise("none")
    return s.groupBy("label", notice.alias("notice")).agg(F.count("*").alias("rows"), F.count_if(F.col("made") >= LIKELY).alias("found"))


def found(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """file_id of the files not written by hand."""
    return judged(files, upstream).filter("verdict IS NOT NULL").select("file_id")
