"""Problem 4: variant spellings of names typed by people and organisations.

Names are folded and cut into tokens; distinct given-family forms (not rows) are compared. MinHash bands over the padded
q-grams of the distinct words, their number taken from the collision curve for a wanted recall, propose pairs of like
words; two forms are candidates if their given names and their families are like words, in either order, so that forms
of a frequent family do not all meet; Monge-Elkan similarity with Jaro-Winkler inside verifies them; star clustering, the most frequent forms first, makes entities. Rows
that do not spell a whole name (initials, nicknames, handles) join the star whose address or alias they share, if it
is the only one that their name allows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import cut, forget, staged, sweep

Q, ROWS, LIKE, RECALL = 3, 2, 0.45, 0.97
#: Least Monge-Elkan similarity of forms, and of one pair of tokens.
SIMILAR, TOKEN = 0.90, 0.86
#: Least likeness of two known given names of more than one edit.
GIVEN = 0.93
#: Bits of a word's letters: first, second and, of the frequent ones, third occurrences.
BITS = {x: n for n, x in enumerate([(c, k) for k in (1, 2) for c in "abcdefghijklmnopqrstuvwxyz"] + [(c, 3) for c in "aeiourstln"])}
#: A token with this many different partners is a given name.
PARTNERS = 6
#: Words of a band's bucket that a task compares with all of it; fuller buckets are split.
BUCKET = 2_000
#: Forms of a family up to which each is compared with all of them (or that share of all forms: FAMILIES families at most are fuller, and they are broadcast).
FAMILY, FAMILIES = 100, 10_000

# Names of nobody, local parts of shared addresses, words of organisations, letters that do not decompose.
NOBODY = frozenset("your name|you|name|user|admin|administrator|unknown|ubuntu|root|ci|dev|developer|none|null|n/a|na|nobody|anonymous|test|guest|localhost|system|bot|default|git|builder|build|deploy|jenkins|runner|worker|vagrant|debian|pi|me|no name|noname|first last|john doe|todo|example|author|committer|github|gitlab|automation|noreply|no-reply".split("|"))
ROLES = frozenset("admin administrator root user ubuntu ci dev devs build builds builder bot bots noreply no-reply donotreply team oss opensource info release releases contact office support hello git github security ops infra it mail hr sales jobs help webmaster postmaster automation jenkins deploy test tests example you your name home family unknown nobody system maintainers maintainer core eng engineering".split())
ORG_WORDS = {"engineering": "engi", "eng": "engi", "laboratories": "labo", "laboratory": "labo", "labs": "labo", "lab": "labo", "software": "soft", "sw": "soft", "systems": "syst", "sys": "syst", "technologies": "tech", "technology": "tech", "tech": "tech", "research": "rese", "institute": "rese", "inst": "rese", "foundation": "foun", "university": "univ", "group": "grou", "company": "comp", "corporation": "corp", "solutions": "solu", "consulting": "cons"}
ORG_EXTRA = frozenset("the team bot inc ltd llc gmbh ag ab bv sa co corp plc oy as nv kg ev".split())
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "đ": "d", "Đ": "D", "ı": "i", "þ": "th", "ð": "d", "’": "'"})
PARSED = "struct<kind:string,tokens:array<string>,initials:string,single:string,addr:string,local:string,handle:string,domain:string,swapped:boolean>"


def mended(s: str) -> str:
    """UTF-8 that was read as a one-byte encoding, put right."""
    if re.search("[ÃÂÅÄ][\u0080-ÿŒ-Ÿ‐-™]", s):
        for code in ("cp1252", "latin-1"):
            try:
                return s.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return s


def folded(s: str) -> str:
    s = unicodedata.normalize("NFKD", mended(s).translate(LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c))


def squeezed(s: str) -> str:
    """Spelled-out umlauts as plain vowels, in all names alike."""
    return re.sub("(?<=[aou])e", "", s)


def parse_person(name: str | None, email: str | None) -> tuple:
    """Fields of one row; kind is person, org or nobody."""
    raw = folded(re.sub(r"\([^)]*\)|<[^>]*>|\"[^\"]*\"", " ", name or "")).strip()
    mail = re.sub(r"\s", "", folded(email or "").lower()).strip("<>")
    user, _, domain = mail.rpartition("@")
    addr = local = handle = ""
    if user and domain:
        tagless = user.split("+", 1)
        noreply = "noreply" in domain
        user = tagless[1] if noreply and len(tagless) > 1 else tagless[0]
        host = re.match(r"(.+?)-(?:laptop|pc|desktop|macbook\S*|mbp)\.(?:local|lan|home)$", domain)
        dead = re.search(r"(?:^|\.)(?:localhost|localdomain|invalid|local|lan|example\.com|test\.com)$|^localhost", domain) or re.fullmatch(r"[\d.]+", domain)
        if host:
            handle = host.group(1)
        elif not dead:
            handle = user
            addr = f"{mail.split('@')[0] if noreply else user}@{domain}"
        local = squeezed(re.sub(r"[^a-z]", "", handle))
        if re.sub(r"\d+$", "", user) in ROLES:
            addr = ""
            if not host:
                local = handle = ""
        domain = "" if dead and not host else domain
    swapped = "," in raw
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", raw)
    words = re.findall(r"[A-Za-z']+", spaced)
    lower = [w.lower().strip("'") for w in words if w.strip("'")]
    plain = " ".join(lower)
    lower = [squeezed(w) for w in lower] if plain not in NOBODY else lower
    company = re.match(r"([a-z]+)-(engi|labo|soft|syst|tech|rese|foun|univ|grou|comp|corp|solu|cons)[a-z]*\.", domain)
    typed = plain.split()
    kinds = [w for w in typed if w in ORG_WORDS]
    if company or kinds and len(lower) >= 2 or len(typed) >= 2 and typed[-1] == "bot" and company:
        rest = [w for w in typed if w not in ORG_WORDS and w not in ORG_EXTRA and len(w) > 1]
        root = company.group(1) if company else "".join(rest)
        kind = company.group(2) if company else ORG_WORDS[kinds[0]]
        if root:
            return "org", ["@" + kind, root], "", "", addr, local, handle, domain, False
    placeholder = plain in NOBODY or not lower or re.sub(r"[^a-z]", "", raw.lower()) in NOBODY
    if placeholder and not addr:
        return "nobody", [], "", "", "", "", "", "", False
    if placeholder:
        return "person", [], "", "", addr, local, handle, domain, False
    if re.search(r"\d", raw) and len(lower) == 1 or len(lower) == 1 and len(words[0]) > 2:
        return "person", [], "", lower[0], addr, local, handle, domain, False
    caps = [w for w in words if len(w) <= 2 and w.isupper()]
    long = [w for w in lower if len(w) > 1 and w.upper() not in caps]
    short = "".join(w.lower() for w in words if len(w) == 1 or w in caps)
    if len(long) >= 2:
        return "person", [long[0], long[-1]], short, "", addr, local, handle, domain, swapped
    if len(long) == 1 and short:
        return "person", long, short, "", addr, local, handle, domain, swapped
    return "person", [], short or "".join(w[0] for w in lower), long[0] if long else "", addr, local, handle, domain, swapped


def parsed(persons: DataFrame) -> DataFrame:
    def run(name: pd.Series, email: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_person(n, e) for n, e in zip(name, email)], columns=["kind", "tokens", "initials", "single", "addr", "local", "handle", "domain", "swapped"])

    p = F.pandas_udf(run, PARSED).asNondeterministic()("name", "email")
    blank = lambda c: F.nullif(F.col(f"p.{c}"), F.lit("")).alias(c)
    return persons.select("person_id", p.alias("p")).select("person_id", "p.kind", "p.tokens", blank("initials"), blank("single"), blank("addr"), blank("local"), blank("handle"), blank("domain"), "p.swapped")


# ---------------------------------------------------------------- similarity


def bands_for(like: float = LIKE, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands that the collision curve 1 - (1 - s^r)^b needs for a recall at a likeness."""
    return math.ceil(math.log(1 - recall) / math.log(1 - like**rows))


def band_keys(words: pd.Series, bands: int, rows: int, q: int = Q) -> list[list[int]]:
    """Keys of the MinHash bands of each word's padded q-grams."""
    r = np.random.default_rng(5)
    a, b = (r.integers(1, (1 << 61) - 1, bands * rows, np.int64).astype(np.uint64) | np.uint64(1) for _ in range(2))
    out = []
    for w in words:
        padded = "^" * (q - 1) + w + "$" * (q - 1)
        grams = {padded[i : i + q] for i in range(len(padded) - q + 1)}
        h = np.array([int.from_bytes(g.encode()[:8].ljust(8, b"\0"), "little") for g in grams], np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        low = ((h[:, None] * a[None, :] + b[None, :]) >> np.uint64(8)).min(axis=0).reshape(bands, rows)
        key = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(rows):
            key = (key ^ low[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out.append(key.view(np.int64).tolist())
    return out


def slip_keys(words: pd.Series) -> list[list[int]]:
    """Keys of each word with one letter or none left out: words that one slip (a letter more, less, other, or two in turn) parts share one."""
    out = []
    for w in words:
        less = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}
        out.append(np.array([xxhash.xxh64_intdigest(x, 4) for x in sorted(less)], np.uint64).view(np.int64).tolist())
    return out


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, hits = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    turned = sum(x != y for x, y in zip(hits, (b[j] for j in range(m) if used[j]))) / 2
    k = len(hits)
    jaro = (k / n + k / m + (k - turned) / k) / 3
    prefix = next((i for i in range(min(4, n, m)) if a[i] != b[i]), min(4, n, m))
    return jaro + 0.1 * prefix * (1 - jaro)


def letter_bits(word: str) -> int:
    """The letters of a word as a mask of their first occurrences."""
    seen: dict[str, int] = {}
    out = 0
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        if (c, seen[c]) in BITS:
            out |= 1 << BITS[c, seen[c]]
    return out


def likeness_bound(a: str, n: str, bits_a: str, b: str, m: str, bits_b: str) -> Column:
    """The most that Jaro-Winkler can be for columns of words, their lengths and letters: all common letters match in order."""
    spare = F.least(F.col(n) - F.bit_count(bits_a), F.col(m) - F.bit_count(bits_b))
    common = F.bit_count(F.col(bits_a).bitwiseAND(F.col(bits_b))) + spare
    jaro = F.when(common > 0, (common / F.col(n) + common / F.col(m) + 1) / 3).otherwise(0.0)
    start = lambda k: F.substring(a, 1, k) == F.substring(b, 1, k)
    prefix = F.when(~start(1), 0).when(~start(2), 1).when(~start(3), 2).when(~start(4), 3).otherwise(4)
    return jaro + 0.1 * prefix * (1 - jaro)


def monge_elkan(a: list[str], b: list[str], inner=jaro_winkler) -> float:
    """Symmetric: the smaller of the two mean best matches."""
    if not len(a) or not len(b):
        return 0.0
    one = lambda x, y: sum(max(inner(s, t) for t in y) for s in x) / len(x)
    return min(one(a, b), one(b, a))


# ---------------------------------------------------------------- clustering


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and center. nodes: node, weight; edges: a, b in both directions.

    A node is a center when no undecided neighbour goes before it (by weight, then name); its undecided neighbours are
    satellites of the first center they touch. Only edges between undecided nodes are carried to the next
    round, and it runs until there are none; the first undecided node of all is decided in every round.
    """
    rank = lambda n, r: nodes.select(F.col("node").alias(n), F.struct("weight", "node").alias(r))
    live, done = cut(edges.select("a", "b").filter("a <> b").join(rank("a", "ra"), "a").join(rank("b", "rb"), "b")), []
    while not done or not live.isEmpty():
        top = live.groupBy("a", "ra").agg(F.max("rb").alias("m")).filter("ra > m").select("a")
        near = live.join(top.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max("rb").alias("m")).select("a", F.col("m.node").alias("center"))
        decided = cut(top.select("a", F.col("a").alias("center")).unionByName(near))
        done.append(decided)
        gone = decided.select("a")
        live = cut(live.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti"))
    return nodes.select("node").join(reduce(DataFrame.unionByName, done), F.col("node") == F.col("a"), "left").select("node", F.coalesce("center", "node").alias("center"))


def short_forms(nicknames: DataFrame) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "(?<=[aou])e", "").alias(c)
    return nicknames.select(plain("nick"), plain("given")).dropna().distinct()


def forms_of(rows: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Rows with a whole name: person_id, given (long form), typed given, family, and the rest."""
    two = rows.filter(F.size("tokens") == 2).select("*", F.col("tokens")[0].alias("t1"), F.col("tokens")[1].alias("t2"))
    people = two.filter("kind = 'person'")
    pairs = people.select("t1", "t2").distinct()
    partners = pairs.unionByName(pairs.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"))).distinct().groupBy("t1").agg(F.count("*").alias("n")).filter(F.col("n") >= PARTNERS)
    nick = short_forms(nicknames)
    known = partners.select(F.col("t1").alias("token")).union(nick.select("nick")).union(nick.select("given")).distinct()
    one = known.select(F.col("token").alias("t1"), F.lit(True).alias("g1"))
    other = known.select(F.col("token").alias("t2"), F.lit(True).alias("g2"))
    two = two.join(one, "t1", "left").join(other, "t2", "left")
    turn = F.when(F.col("g1").isNotNull() & F.col("g2").isNull(), False).when(F.col("g2").isNotNull() & F.col("g1").isNull(), True).otherwise(F.col("swapped"))
    turn = F.when(F.col("kind") == "org", False).otherwise(turn)
    two = two.withColumn("turn", turn).withColumn("typed", F.when(F.col("turn"), F.col("t2")).otherwise(F.col("t1"))).withColumn("family", F.when(F.col("turn"), F.col("t1")).otherwise(F.col("t2")))
    two = two.withColumn("known", F.when(F.col("turn"), F.col("g2")).otherwise(F.col("g1")).isNotNull()).drop("t1", "t2", "g1", "g2", "turn")
    # of several long forms of a nickname the one that the family is seen with, else the first
    full = two.groupBy("family", F.col("typed").alias("given")).agg(F.count("*").alias("seen"))
    option = two.select("family", "typed").distinct().join(nick, F.col("typed") == F.col("nick")).join(full, ["family", "given"], "left")
    option = option.groupBy("family", "typed").agg(F.min_by("given", F.struct(-F.coalesce("seen", F.lit(0)), F.col("given"))).alias("given"))
    return two.join(option, ["family", "typed"], "left").withColumn("given", F.coalesce("given", "typed"))


def like_words(words: DataFrame) -> DataFrame:
    """word, other and s, their Jaro-Winkler likeness, of all pairs (both ways, and every word with itself) of at least TOKEN that share a band,
    or that one slip parts: in short words it leaves too few q-grams for the bands.

    A bucket of more than BUCKET words is compared in blocks, each with the whole bucket. Pairs whose letters alone
    exclude the likeness are dropped in the engine, so few reach the similarity.
    """
    bands = bands_for()

    def keys(w: pd.Series) -> pd.Series:
        return pd.Series([a + b for a, b in zip(band_keys(w, bands, ROWS), slip_keys(w))], dtype=object)

    letters = F.pandas_udf(lambda w: pd.Series([letter_bits(x) for x in w], dtype="int64"), "bigint")("word")
    keys_of_words = staged(words.select("word", F.length("word").alias("n"), letters.alias("bits"), F.explode(F.pandas_udf(keys, "array<bigint>")("word")).alias("key")), "keys")
    blocks = keys_of_words.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"), F.count("*").alias("c")).filter("c > 1").select("key", "blocks")
    keyed = keys_of_words.join(blocks, "key")
    left = keyed.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", *[F.col(c).alias(f"{c}_o") for c in ("n", "bits")], F.col("word").alias("other"))
    near = left.join(other, ["key", "block"]).filter((F.col("word") < F.col("other")) & (likeness_bound("word", "n", "bits", "other", "n_o", "bits_o") >= TOKEN - 1e-9)).select("word", "other").distinct()

    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(a, b) for a, b in zip(x, y)], dtype=float)

    near = near.withColumn("s", F.pandas_udf(likeness, "double").asNondeterministic()("word", "other")).filter(F.col("s") >= TOKEN)
    back = near.select(F.col("other").alias("word"), F.col("word").alias("other"), "s")
    out = staged(near.unionByName(back).unionByName(words.select("word", F.col("word").alias("other"), F.lit(1.0).alias("s"))), "near")
    forget(keys_of_words)
    return out


def candidate_forms(asked: DataFrame, view: DataFrame, near: DataFrame, to_family: str, to_name: str) -> DataFrame:
    """a, b: forms of asked and view of which to_family is like the family and to_name like the given name, as far as bounds tell; form_likeness decides.

    A form meets the forms of a like family, and letters drop those of other given names before anything is shuffled. A
    family of more than FAMILY forms would meet itself whole, so there the like given names are part of the key. view should be checkpointed.
    """
    straight, least = to_family == "family", 2 * SIMILAR - 0.04
    step = lambda c, to, score: near.select(F.col("word").alias(c), F.col("other").alias(to), F.col("s").alias(score))
    target = view.select(F.col("node").alias("b"), F.col("family").alias("f"), F.col("name").alias("g"), F.col("name_n").alias("g_n"), F.col("name_bits").alias("g_bits"), F.col("known").alias("known_b"))
    full = F.broadcast(cut(target.groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") > max(FAMILY, view.count() // FAMILIES)).select("f")))
    likely = step(to_family, "f", "sf")
    if straight:
        likely = likely.filter("f >= family")
    # both known: one edit or a high likeness of the given names
    close = lambda like: ~(F.col("known") & F.col("known_b")) | (like >= GIVEN - 1e-9) | (F.levenshtein(to_name, "g") <= 1) if straight else F.lit(True)
    bound = likeness_bound(to_name, f"{to_name}_n", f"{to_name}_bits", "g", "g_n", "g_bits")
    mine = asked.select(F.col("node").alias("a"), "known", "family", "name", f"{to_name}_n", f"{to_name}_bits")
    few = mine.join(likely.join(full, "f", "left_anti"), to_family).join(target.join(full, "f", "left_anti"), "f")
    few = few.filter((bound >= F.greatest(F.lit(TOKEN), least - F.col("sf")) - 1e-9) & close(bound))
    many = mine.join(likely.join(full, "f", "left_semi"), to_family).join(step(to_name, "g", "sg"), to_name).filter(F.col("sf") + F.col("sg") >= least)
    many = many.join(target.join(full, "f", "left_semi").select("b", "f", "g", "known_b"), ["f", "g"]).filter(close(F.col("sg")))
    return few.select("a", "b").unionByName(many.select("a", "b")).filter("a <> b")


def similar_forms(forms: DataFrame) -> DataFrame:
    """a, b: forms (in both directions) whose names are spellings of one another. forms: node, given, names, family, known, confirmed."""
    letters = F.pandas_udf(lambda w: pd.Series([letter_bits(x) for x in w], dtype="int64"), "bigint")
    view = forms.select("node", "family", "known", F.explode("names").alias("name"))
    view = cut(view.select("*", *[x for c in ("name", "family") for x in (F.length(c).alias(f"{c}_n"), letters(c).alias(f"{c}_bits"))]))
    near = like_words(view.select(F.col("name").alias("word")).union(view.select("family")).distinct())
    sweep(forms.sparkSession)
    # both ways straight pairs are the same pairs; crossed ones are asked of the side whose given name is not known
    straight = candidate_forms(view, view, near, "family", "name").select("a", "b")
    crossed = candidate_forms(view.filter("NOT known"), view, near, "name", "family").select("a", "b")
    pairs = cut(straight.unionByName(crossed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(near)
    del near, straight, crossed
    sweep(forms.sparkSession)
    # short forms of a given name begin with its first two letters
    start = view.withColumn("start", F.substring("name", 1, 2))
    short = start.select(F.col("node").alias("a"), "family", "start", F.col("name").alias("x")).join(start.select(F.col("node").alias("b"), "family", "start", F.col("name").alias("y")), ["family", "start"])
    short = short.filter((F.col("a") < F.col("b")) & shortened(F.col("x"), F.col("y"))).select("a", "b").distinct()
    side = lambda k: forms.select([F.col(c).alias(f"{c}_{k}") for c in ("node", "names", "family", "known", "confirmed")]).withColumnRenamed(f"node_{k}", k)
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")

    def verify(na: pd.Series, fa: pd.Series, nb: pd.Series, fb: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([form_likeness(*x) for x in zip(na, fa, nb, fb, known)], dtype=float)

    apart = F.col("confirmed_a") & F.col("confirmed_b") & (F.col("family_a") != F.col("family_b"))
    score = F.pandas_udf(verify, "double").asNondeterministic()("names_a", "family_a", "names_b", "family_b", F.col("known_a") & F.col("known_b"))
    good = pairs.filter(~apart).withColumn("s", score).filter(F.col("s") >= SIMILAR).select("a", "b").unionByName(short)
    return good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def shortened(x: Column, y: Column) -> Column:
    """Whether one may be a short form of the other: a prefix, or a short word with the same first three letters."""
    least = F.least(F.length(x), F.length(y))
    return (least >= 2) & (F.startswith(x, y) | F.startswith(y, x)) | (least >= 3) & (least <= 5) & (F.substring(x, 1, 3) == F.substring(y, 1, 3))


def form_likeness(names_a: list[str], family_a: str, names_b: list[str], family_b: str, known: bool) -> float:
    """Monge-Elkan similarity of the likest given names with the families, in either order; 0 for different known names."""
    best = 0.0
    for a in names_a:
        for b in names_b:
            near = a == b or sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)) <= 1 or jaro_winkler(a, b) >= GIVEN
            if known and not near:
                continue
            straight = min(jaro_winkler(a, b), jaro_winkler(family_a, family_b)) >= TOKEN
            crossed = min(jaro_winkler(a, family_b), jaro_winkler(family_a, b)) >= TOKEN
            if straight or crossed:
                best = max(best, monge_elkan([a, family_a], [b, family_b]))
    return best


def fits(given: Column, family: Column) -> Column:
    """Whether the partial name of a row may be that of a whole name; rows without a name fit all."""
    first, single, initials = F.substring(given, 1, 1), F.col("single"), F.col("initials")
    low = F.regexp_replace(F.coalesce(single, F.lit("")), "[^a-z]", "")
    as_single = F.when(single.isNull(), True).otherwise(
        F.contains(given, low) | F.startswith(low, given) | (F.substring(low, 1, 1) == first) | (F.col("nick_given") == given) | F.startswith(family, low) | F.contains(low, F.substring(family, 1, 4)) | (F.levenshtein(low, given) <= 2) | (F.col("local") == low)
    )
    token = F.element_at("tokens", 1)
    as_token = F.when(F.size("tokens") != 1, True).otherwise((F.levenshtein(token, family) <= 2) | (F.levenshtein(token, given) <= 2) | (F.col("nick_given") == given))
    ends = F.concat(first, F.substring(family, 1, 1))
    as_initials = F.when(initials.isNull(), True).when(F.size("tokens") == 1, (F.substring(initials, 1, 1) == first) | (F.levenshtein(token, given) <= 2)).otherwise(
        (F.substring(initials, 1, 1) == first) & (F.substring(initials, -1, 1) == F.substring(family, 1, 1)) | (initials == F.reverse(ends))
    )
    return as_single & as_token & as_initials


def entities(persons: DataFrame, nicknames: DataFrame) -> DataFrame:
    """person_id and entity of every row that stands for somebody.

    Rows of nobody (blank, placeholders, machine accounts) have none. Equal rows share an entity, null names go by their
    address, null addresses by their name; a row that fits several entities alike stays apart.
    """
    rows = cut(parsed(persons.select("person_id", "name", "email")).filter("kind <> 'nobody'"))
    whole = cut(forms_of(rows, nicknames).withColumn("node", F.concat_ws(" ", "given", "family")))
    forms = cut(whole.groupBy("node", "given", "family").agg(
        F.count("*").alias("weight"), F.array_distinct(F.concat(F.array(F.first("given")), F.collect_set("typed"))).alias("names"), F.max("known").alias("known"), F.max(F.col("kind") == "org").alias("org"),
        F.max(F.coalesce(F.contains("local", "family") | (F.col("local") == F.concat(F.substring("given", 1, 3), F.substring("family", 1, 4))), F.lit(False)) | (F.col("kind") == "org") & F.coalesce(F.startswith("domain", "family"), F.lit(False))).alias("confirmed"),
    ))
    # whole names at one personal address are one person if their families have a likeness
    hub = whole.filter("addr IS NOT NULL AND kind = 'person'").groupBy("addr").agg(F.max_by("node", F.struct(F.coalesce(F.contains("local", "family"), F.lit(False)), F.col("node"))).alias("hub"))
    same = whole.filter("addr IS NOT NULL AND kind = 'person'").join(hub, "addr").filter("node <> hub").select("node", "hub").distinct()
    h = forms.select(F.col("node").alias("hub"), F.col("given").alias("hg"), F.col("family").alias("hf"))
    same = same.join(forms.select("node", "given", "family"), "node").join(h, "hub").filter((F.levenshtein("family", "hf") <= 2) | (F.levenshtein("given", "hf") <= 2) | (F.levenshtein("family", "hg") <= 2)).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # a name whose address spells another whole name of its family, and not its own
    def spellings(g: Column, f: Column) -> Column:
        return F.array(F.concat(g, f), F.concat(f, g), F.concat(F.substring(g, 1, 1), f), F.concat(f, F.substring(g, 1, 1)))

    spelled = forms.filter("NOT org").select(F.col("node").alias("hub"), F.col("family").alias("hf"), F.explode(F.array_distinct(spellings(F.col("given"), F.col("family")))).alias("local"))
    told = whole.filter("local IS NOT NULL AND kind = 'person'").filter(~F.array_contains(spellings(F.col("given"), F.col("family")), F.col("local")))
    told = told.join(spelled, "local").filter((F.col("family") == F.col("hf")) & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    same = same.unionByName(told).distinct()
    edges = similar_forms(forms).unionByName(same).unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    weights = forms.select("node", F.struct(F.col("confirmed"), F.col("known"), F.col("weight")).alias("weight"))
    stars = cut(star_clusters(weights, edges))
    del same, told, edges
    sweep(persons.sparkSession)
    whole_entity = cut(whole.join(stars, "node").select("person_id", "kind", "addr", "handle", "local", "domain", F.col("center").alias("entity")))

    # what a star is known by
    center = forms.join(stars.filter("node = center").select("node"), "node").filter("NOT org").select(F.col("node").alias("entity"), "given", "family")
    g, f = F.col("given"), F.col("family")
    alias = center.select("entity", "given", "family", F.explode(F.array_distinct(F.array(
        F.concat(g, f), F.concat(f, g), F.concat(F.substring(g, 1, 1), f), F.concat(f, F.substring(g, 1, 1)), f, F.concat(F.substring(g, 1, 3), F.substring(f, 1, 4)),
    ))).alias("alias"))
    nick = short_forms(nicknames).select(F.col("nick").alias("single_nick"), F.col("given").alias("nick_given"))
    part = rows.join(whole_entity.select("person_id"), "person_id", "left_anti").filter("kind = 'person'")
    part = part.withColumn("single_nick", F.coalesce("single", F.when(F.size("tokens") == 1, F.element_at("tokens", 1)))).join(nick, "single_nick", "left")
    part = cut(part)
    names = center.select("entity", "given", "family")
    word = F.coalesce(F.when(F.size("tokens") == 1, F.concat(F.element_at("tokens", 1), F.substring("initials", 1, 1))), F.regexp_replace("single", "[^a-z]", ""))
    way = lambda kind, score, key: F.struct(F.lit(kind).alias("way"), F.lit(score).alias("score"), key.alias("key"))
    asked = part.withColumn("w", F.explode(F.array(way("addr", 3, F.col("addr")), way("handle", 2, F.col("handle")), way("alias", 1, F.col("local")), way("alias", 1, word)))).select("*", "w.*").filter("key IS NOT NULL")
    mine = whole_entity.filter("kind = 'person'").select("entity", F.explode(F.array(way("addr", 3, F.col("addr")), way("handle", 2, F.col("handle")))).alias("w")).select("entity", "w.way", "w.key").filter("key IS NOT NULL")
    known = mine.unionByName(alias.select("entity", F.lit("alias").alias("way"), F.col("alias").alias("key"))).distinct().join(names, "entity")
    option = asked.join(known, ["way", "key"])
    option = option.filter(fits(g, f)).groupBy("person_id", "entity").agg(F.max("score").alias("score"), F.count("*").alias("ways"))
    w = Window.partitionBy("person_id").orderBy(F.desc("score"))
    best = option.withColumn("r", F.rank().over(w)).filter("r = 1").groupBy("person_id").agg(F.min("entity").alias("entity"), F.count("*").alias("n")).filter("n = 1").select("person_id", "entity")
    left = part.select("person_id", "addr", "handle").distinct().join(best, "person_id", "left_anti")
    own = left.filter("addr IS NOT NULL").select("person_id", F.concat(F.lit("<"), F.coalesce("handle", "addr"), F.lit(">")).alias("entity"))
    return whole_entity.select("person_id", "entity").unionByName(best).unionByName(own)


def found(persons: DataFrame, nicknames: DataFrame) -> DataFrame:
    """person_id_a < person_id_b of rows of one entity."""
    e = cut(entities(persons, nicknames).distinct())
    a, b = e.select("entity", F.col("person_id").alias("person_id_a")), e.select("entity", F.col("person_id").alias("person_id_b"))
    return a.join(b, "entity").filter("person_id_a < person_id_b").select("person_id_a", "person_id_b")
