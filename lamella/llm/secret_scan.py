"""Secret scans: candidates by pattern, false positives removed by a random forest, all of it SQL expressions.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover,
the path it comes from and the words beside it. It is fitted on the driver from a bounded table of
labelled findings whose features the same expressions compute; what runs over the texts is the
fitted trees as CASE expressions. A scan gives each candidate a row of its own before anything is measured, so
its work grows with their number; redaction stays within a text's row. Nothing is
shuffled, so neither a hot source nor repeated texts gather anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import numbered, only, place
from lamella.llm.trees import Ensemble, random_forest

#: Labelled findings that the forest is fitted on, at most.
TRAIN_ROWS = 20_000
#: Characters of the text on either side that count as neighbouring words.
BESIDE = 48

# What a candidate looks like. Keys of known marks, wherever in a run they start; values assigned after key words, whatever their
# length and characters; runs of 16 and more letters, digits, + / _ - with a digit or an upper-case letter after a lower-case one anywhere,
# up to the next marked key. Rows of four and more signs are no beginning. All loops are possessive: time is linear and no stack grows.
_RUN, _PART = "[A-Za-z0-9+/_-]", "[A-Za-z0-9_-]"
_MARKED = (
    rf"(?=[AgsrxeS])(?:A[KS]IA[A-Z0-9]{{16,}}+|gh[pousr]_[A-Za-z0-9]{{16,}}+|github_pat_[A-Za-z0-9_]{{16,}}+|glpat-{_PART}{{16,}}+|(?<![A-Za-z0-9])(?:sk-|[sr]k_live_){_PART}{{16,}}+"
    rf"|xox[abeprs]-[A-Za-z0-9-]{{10,}}+|AIza{_PART}{{32,}}+|eyJ{_PART}{{5,}}+(?:[.]{_PART}{{5,}}+){{1,4}}+|(?<![A-Za-z0-9])SG[.]{_PART}{{10,}}+[.]{_PART}{{10,}}+)"
)
_KEY = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credentials?|auth|bearer)[A-Za-z0-9_]{0,8}"
_ASSIGNED = rf"""(?<=[=:>\s"'])(?<=[=:>][ \t]{{0,4}}["']?)(?<={_KEY}["']?[ \t]{{0,4}}[=:]{{1,3}}>?[ \t]{{0,4}}["']?)(?:(?<=")[^"\r\n]++(?=")|(?<=')[^'\r\n]++(?=')|[^\s"',;&<>(){{}}\[\]=:]{_RUN}*+[^\s"',;&<>(){{}}\[\]]*+)"""
_CANDIDATE = rf"{_ASSIGNED}|{_MARKED}|(?:(?<!{_RUN})(?![+/_-]{{4}})|(?<=[+/_-]{{4}})(?![+/_-]))(?=[A-Za-z+/_-]*+[0-9]|[A-Z+/_-]*+(?:[a-z]++[+/_-]++[A-Z+/_-]*+)*+[a-z]++[A-Z])(?:(?!{_MARKED}){_RUN}){{16,}}+={{0,2}}"
# Words that identifiers and placeholders are made of.
_DICTIONARY = (
    "about access account action active address admin after agent allow append array asset async base batch before begin block body branch buffer build button byte cache call change channel "
    "char check child class clear client clone close cloud code collect column command commit common compute config connect const container content context control convert copy count create current "
    "data date debug default define delete demo device dict docker document domain download dummy edit element email empty enable encode entry error event example execute export extra factory "
    "false feature field file filter find first fixme folder format frame from function general generate global group handle header hello helper here home host html http image import index info init "
    "inner input insert install instance int item iter java json just key kernel label language last layer layout length level library line link linux list load local lock login long main "
    "make manager match max member memory message method model module name network next node none null number object open option order output package page param parse password path "
    "pattern pipe place plain plugin point policy pool port post prefix print private process product profile project property provider proxy public python query queue range rate read record "
    "remote remove render replace report request require reset resource response result return role root route row rule run sample save scale schema scope screen script search second secret section "
    "select self send sequence server service session set setup shape share shell signal simple size slice source spec stack start state static status step stop store stream string style submit "
    "suite switch symbol sync system table target task temp template test text theme thread time title token tool total trace track tree trigger true tuple type union unit update upload url usage "
    "user util valid value variable vector version view void wait web widget window word worker wrapper write your zero zone"
).split()
# Words beside a candidate that speak for or against a secret.
_FOR = "token|secret|passw|passphrase|pwd|api.?key|access.?key|private|credential|auth|bearer|signature|client.?id"
_AGAINST = "commit|sha.?1|sha.?256|md5|checksum|digest|hash|uuid|guid|revision|version|build|example|sample|dummy|placeholder|test|fixture|order|invoice|phone|card|href|http|src|isbn"
_MARKS = "A[KS]IA[A-Z0-9]{16}|gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_live_|xox[abeprs]-|AIza|eyJ|SG[.]"
_NAMED = "[a-z0-9_]*[\"\\']?[ ]*[=:]{1,3}>?[ ]*[\"\\']?$"

#: The features by name, as SQL over c.text, c.before, c.after, c.path.
FEATURES: dict[str, str] = {
    "length": "char_length(c.text)",
    "transitions": "regexp_count(c.text, '(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]') / char_length(c.text)",
    "lower_upper": "regexp_count(c.text, '(?<=[a-z])[A-Z]') / char_length(c.text)",
    "vowel_pairs": "regexp_count(c.text, '(?i)[aeiou][bcdfghjklmnpqrstvwxyz]') / char_length(c.text)",
    "digits": "regexp_count(c.text, '[0-9]') / char_length(c.text)",
    "signs": "regexp_count(c.text, '[+/_-]') / char_length(c.text)",
    "distinct": "size(array_distinct(split(c.text, ''))) / char_length(c.text)",
    "hexadecimal": "cast(c.text rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' as int)",
    "hex_bytes": "cast(c.text rlike '^[0-9a-fA-F]+$' and char_length(c.text) in (32, 40, 64) as int)",
    "uuid": "cast(c.text rlike '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$' as int)",
    "mark": f"cast(c.text rlike '^(?:{_MARKS})' as int)",
    "dictionary": f"1 - char_length(regexp_replace(lower(c.text), '{'|'.join(sorted(_DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / char_length(c.text)",
    "path_test": "cast(lower(c.path) rlike 'test|spec|fixture|example|sample|mock|doc|readme|lock' as int)",
    "path_config": "cast(lower(c.path) rlike '[.]env|config|settings|secret|credential|[.]ya?ml|[.]ini|[.]pem' as int)",
    "words_for": f"regexp_count(lower(c.before), '{_FOR}')",
    "words_against": f"regexp_count(lower(c.before), '{_AGAINST}')",
    "after_against": f"regexp_count(lower(c.after), '{_AGAINST}')",
    "assigned": "cast(c.before rlike '[=:]>?[ ]?[\"\\']?$' as int)",
    "assigned_for": f"cast(lower(c.before) rlike '(?:{_FOR}){_NAMED}' as int)",
    "assigned_against": f"cast(lower(c.before) rlike '(?:{_AGAINST}){_NAMED}' as int)",
    "near_against": f"regexp_count(lower(right(c.before, 16)), '{_AGAINST}')",
    "quoted": "cast(c.before rlike '[\"\\']$' and c.after rlike '^[\"\\']' as int)",
    "url_before": "cast(c.before rlike '[/?&.#]$' as int)",
}


def labelled_findings(spark: SparkSession, rows: int = 12_000) -> DataFrame:
    """text, before, after, path, label: made findings of known truth, the same on every call.

    Form, words before, way of assignment and path are drawn independently of each other; the truth follows from them. Keys of known marks are
    secrets wherever they stand. Random letters and passwords are where a key word names them, hexadecimal strings and uuids only where it names them directly.
    Where the words before call it an example and the path is one of tests or documents, an unmarked one is none. Identifiers, paths, numbers,
    calls, words and placeholders are never secrets, whatever stands before them.
    """
    raw = spark.range(rows).selectExpr("id", "sha2(concat('a', id), 256) h", "sha2(concat('b', id), 256) k", "base64(unhex(sha2(concat('c', id), 512))) raw64", "base64(unhex(sha2(concat('d', id), 512))) more64")
    word = "element_at(array({words}), 1 + pmod(hash(id, {{0}}), {n}))"
    plain = "data user list parse value config index module stream record service report batch number result page".split()
    word = word.format(words=", ".join(f"'{w}'" for w in plain), n=len(plain))
    w = [word.format(i) for i in range(12)]

    def pick(salt: int, *options: str) -> str:
        return f"element_at(array({', '.join(options)}), 1 + pmod(hash(id, {salt}), {len(options)}))"

    b, letters = "regexp_replace(raw64, '[^A-Za-z0-9+/]', '')", "translate(regexp_replace(more64, '[+/=]', ''), '0123456789', 'qWzXcVbNmK')"
    safe, size = "translate(regexp_replace(raw64, '=', ''), '+/', 'x9')", "16 + pmod(hash(id, 41), 25)"
    marked = [
        "concat('AKIA', upper(substr(h, 1, 16)))", "concat('AKIA', upper(translate(substr(h, 1, 16), '0123456789', 'QWRTYUIOPS')))", "concat('ASIA', upper(substr(k, 1, 16)))", f"concat('ghp_', substr({safe}, 1, 36))", f"concat('gho_', substr({safe}, 1, 36))",
        f"concat('github_pat_', substr({safe}, 1, 22), '_', substr({safe}, 30, 40))", f"concat('glpat-', substr({safe}, 1, 20))", f"concat('sk-', substr({safe}, 1, 40))", f"concat('sk_live_', substr({safe}, 1, 24))", f"concat('rk_live_', substr({safe}, 1, 24))",
        f"concat('xoxb-', pmod(hash(id, 42), 1000000000), '-', substr({safe}, 1, 24))", f"concat('AIza', substr({safe}, 1, 35))", f"concat('eyJ', substr({safe}, 1, 24), '.eyJ', substr({safe}, 25, 30), '.', substr(more64, 1, 40))", f"concat('eyJ', substr({safe}, 1, 60))", f"concat('SG.', substr({safe}, 1, 22), '.', substr({safe}, 23, 43))",
        "concat('AKIA', upper(substr(h, 1, 9)), 'EXAMPLE')",
    ]
    random = [f"substr({b}, 1, {size})", f"substr({b}, 1, 40)", f"substr({letters}, 1, 24)", f"substr({letters}, 1, {size})", f"concat(substr({w[0]}, 1, 3), initcap({w[1]}), pmod(hash(id, 43), 900), substr({b}, 1, 3), {pick(44, repr(''), repr('!'), repr('#'), repr('?'))})", f"substr({b}, 1, 8 + pmod(hash(id, 45), 7))", f"concat({w[0]}, pmod(hash(id, 46), 10000), substr({letters}, 1, 4))"]
    hexadecimal = ["substr(h, 1, 32)", "substr(h, 1, 40)", "h", "upper(substr(h, 1, 40))", "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"]
    never = [
        f"concat_ws('_', {w[0]}, {w[1]}, {w[2]}, {w[3]}, pmod(hash(id, 47), 100))", f"concat_ws('_', {w[0]}, {w[1]}, {w[2]}, {w[3]})", f"concat({w[0]}, initcap({w[1]}), initcap({w[2]}), initcap({w[3]}), pmod(hash(id, 47), 10))", f"concat({w[0]}, initcap({w[1]}), initcap({w[2]}), initcap({w[3]}))", f"concat_ws('_', upper({w[0]}), upper({w[1]}), upper({w[2]}), '2')",
        "lpad(cast(abs(xxhash64(id)) as string), 16 + pmod(hash(id, 48), 4), '4')", f"concat_ws('/', 'usr', {w[0]}, {w[1]}, {w[2]}, 'v2')", f"concat_ws('/', {w[0]}, {w[1]}, {w[2]}, {w[3]})", f"concat_ws('-', '2024', '01', {w[0]}, {w[1]}, {w[2]})", f"concat_ws('.', {w[0]}, {w[1]}, {w[2]})", f"concat_ws('-', {w[0]}, {w[1]}, {w[2]}, pmod(hash(id, 47), 10000))",
        f"concat('your_', {w[0]}, '_key_here_', pmod(hash(id, 47), 1000))", f"concat('your-', {w[0]}, '-token-here')", f"concat({w[0]}, '_token_placeholder')", f"repeat('x', {size})", pick(49, *map(repr, "None null true string required changeme str the a xxxx password secret optional".split())), w[0], f"concat({w[0]}, ' ', {w[1]}, ' ', {w[2]})",
        f"concat_ws('_', 'get', {w[0]}, {w[1]})", f"concat('get', initcap({w[0]}), 'Token')", f"concat('self.', {w[0]}, '_token')", f"concat('load_', {w[0]})", f"concat('os.environ.', upper({w[0]}), '_KEY')", f"concat({w[0]}, '_', {w[1]}, '_count_', pmod(hash(id, 47), 100))",
    ]
    key = pick(11, *map(repr, "token api_key secret password access_key auth_token client_secret Token TOKEN apiKey db_password privateKey credential".split()))
    digest = pick(16, *map(repr, "commit sha256 md5 checksum digest hash uuid revision build order_id version".split()))
    join = pick(12, "' = \"'", "'=\"'", "': \"'", "'='", "' = '", "': '", "'\":\"'", "' => \\''")
    noise = f"concat({w[4]}, ' ', {w[5]}, ' ')"
    before = {
        "named": f"concat({noise}, {key}, {join})",
        "example": f"concat({noise}, {pick(17, *map(repr, ('example ', 'sample ', 'dummy ', 'test ')))}, {key}, {join})",
        "beside": f"concat({noise}, {pick(18, *map(repr, ('the token is ', 'password ', 'with secret ', 'Authorization Bearer ', 'credentials are ')))})",
        "digest": f"concat({noise}, {digest}, {pick(19, *map(repr, (' ', ': ', '=', ' = ', ': ')))})",
        "digest of key": f"concat({noise}, {digest}, ' of ', {key}, ' ', {pick(20, *map(repr, ('file ', 'list: ', 'table = ', 'is ')))})",
        "neutral": f"concat({noise}, {w[6]}, {join})",
        "prose": f"concat({noise}, {w[6]}, ' ', {w[7]}, ' ')",
        "url": f"concat({noise}, {pick(21, *map(repr, ('http://host/', 'at https://git.host.com/team-name/service/', 'see https://example.org/', 'href=/')))})",
    }
    forms = {"marked": marked, "random": random, "hexadecimal": hexadecimal, "never": never}
    form, where = pick(13, "'marked'", "'random'", "'random'", "'hexadecimal'", "'never'", "'never'"), pick(14, "'named'", "'named'", "'named'", *[repr(k) for k in before if k != "named"])
    drawn = raw.selectExpr("*", f"{form} as form", f"{where} as place", f"{pick(15, *map(repr, ('src/app', 'src', 'config/settings.yml', 'tests/fixture', 'docs/readme', 'lib/core', '', 'src7', 'web')))} as path")
    text = "case form " + " ".join(f"when '{k}' then {pick(31 + i, *v)}" for i, (k, v) in enumerate(forms.items())) + " end"
    lead = "case place " + " ".join(f"when '{k}' then {v}" for k, v in before.items()) + " end"
    # too long for one generated method, so both are evaluated as they stand
    made = drawn.selectExpr("*", f"element_at(transform(array(0), x -> {text}), 1) as text", f"element_at(transform(array(0), x -> {lead}), 1) as before")
    real = "place = 'named' or place = 'example' and not (path like 'tests%' or path like 'docs%')"
    label = f"form = 'marked' or form = 'random' and ({real} or place = 'beside') or form = 'hexadecimal' and ({real})"
    tail = f"if(form = 'never' and text rlike 'get|load', '(', if(before rlike '[\"\\']$', right(before, 1), ' '))"
    return made.selectExpr("text", "before", f"concat({tail}, {w[8]}, ' ', {w[9]}) as after", "path", f"cast({label} as int) as label")


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Ensemble:
    """The forest for these labelled findings (text, before, after, path, label), from at most `rows` of them."""
    shape = only(labelled, "text", "before", "after", "path", "label").select(F.struct(*[F.coalesce(x, F.lit("")).alias(x) for x in ("text", "before", "after", "path")]).alias("c"), "label").where("label is not null and char_length(c.text) > 0")
    share = min(1.0, 0.9 * rows / max(shape.count(), 1))
    draw = shape.where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows)
    got = draw.select("label", F.expr(_once("c", _features())).alias("f")).select("label", "f.*").collect()
    if not got:
        raise ValueError("no labelled finding to learn from")
    got.sort()
    matrix = np.array([list(r) for r in got], np.float64)
    return random_forest(matrix[:, 1:], matrix[:, 0])


#: Candidates whose starts are added up one by one within a run of so many.
_RUN_OF = 256


def candidates(df: DataFrame, text: str, path: str | None) -> DataFrame:
    """df with __scan_parts, the text between candidates, __scan_raw, the candidates, and __scan_path. All null where there is none.
    text and path name columns of df that no other differs from in case only."""
    t = F.col(text).cast("string")
    some = t.rlike(_CANDIDATE)
    return df.withColumns({"__scan_raw": F.when(some, F.regexp_extract_all(t, F.lit(_CANDIDATE), F.lit(0))), "__scan_parts": F.when(some, F.split(t, _CANDIDATE)), "__scan_path": F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")})


def _with(given: dict[str, str], body: str) -> str:
    """SQL for body with z.<name> bound to each expression, which is then computed once a row, whatever the optimizer makes of the plan."""
    return f"element_at(transform(array(named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in given.items())})), z -> {body}), 1)"


def _once(name: str, body: str) -> str:
    """SQL for body over z, the value of a column, evaluated as it stands: the trees are too long for one generated method."""
    return f"element_at(transform(array({name}), z -> {body}), 1)"


def _features(c: str = "z") -> str:
    """The features of a struct of that name."""
    return "named_struct(" + ", ".join(f"'{f}', cast({e.replace('c.', c + '.')} as double)" for f, e in FEATURES.items()) + ")"


_SOME = {"raw": "__scan_raw", "parts": "__scan_parts"}
_CONTEXTS = _with(_SOME, f"transform(z.raw, (r, i) -> named_struct('text', r, 'before', right(z.parts[i], {BESIDE}), 'after', left(z.parts[i + 1], {BESIDE}), 'path', __scan_path))")
# what lies between a candidate's start and the one's before it
_STEPS = _with(_SOME, "transform(z.raw, (r, i) -> char_length(z.parts[i]) + if(i > 0, char_length(z.raw[i - 1]), 0))")
# where each run of candidates begins, and from there each candidate
_BASES = f"aggregate(sequence(0, (size(__scan_steps) - 1) div {_RUN_OF}), named_struct('at', 0, 'all', cast(array() as array<int>)), (s, k) -> named_struct('at', s.at + aggregate(slice(__scan_steps, cast(k * {_RUN_OF} + 1 as int), {_RUN_OF}), 0, (x, y) -> x + y), 'all', array_append(s.all, s.at))).all"
_STARTS = _with({"steps": "__scan_steps", "bases": "__scan_bases"}, f"transform(z.steps, (x, i) -> z.bases[cast(i div {_RUN_OF} as int)] + aggregate(slice(z.steps, cast(i div {_RUN_OF} * {_RUN_OF} + 1 as int), i % {_RUN_OF} + 1), 0, (x, y) -> x + y))")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, score, secret: one row a candidate in docs (doc_id, text, source), rejected ones included.

    A candidate is a key of a known mark wherever in a run it starts, a value assigned after a key word whatever its length
    and characters, or a run of 16 or more letters, digits and + / _ - with a digit or an upper-case letter after a
    lower-case one anywhere in it, up to the next marked key and without four or more signs in front; secret tells whether the forest takes it for one. start and length count code points. Null and
    empty texts give no row; repeated rows give their own; a null source is an empty path; equal candidates in equal surroundings have equal scores. Other
    columns are not read. An empty table gives none.
    """
    forest = fit(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    found = candidates(only(docs, "doc_id", "text", "source"), "text", "source").select("doc_id", "__scan_raw", "__scan_parts", "__scan_path", F.when(F.col("__scan_raw").isNotNull(), F.expr(_STEPS)).alias("__scan_steps"))
    placed = found.withColumn("__scan_bases", F.expr(f"if(size(__scan_steps) > 0, {_BASES}, null)"))
    # a row a candidate from here on; outer, so that no filter on what is exploded is derived and computes it twice
    both = F.when(F.col("__scan_raw").isNotNull(), F.arrays_zip(F.expr(_STARTS).alias("start"), F.expr(_CONTEXTS).alias("c")))
    rows = placed.select("doc_id", F.explode_outer(both).alias("f")).where("f is not null").select("doc_id", F.col("f.start").alias("start"), F.col("f.c").alias("c"))
    measured = rows.withColumn("f", F.expr(_once("c", _features())))
    scored = measured.select("doc_id", F.col("start").cast("long").alias("start"), F.char_length("c.text").cast("long").alias("length"), F.expr(_once("f", forest.sql([f"z.{x}" for x in FEATURES]))).alias("raw"))
    return scored.select("doc_id", "start", "length", F.round("raw", 6).alias("score"), (F.col("raw") >= threshold).alias("secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with every secret in text replaced by mark and n_chars set anew; texts without secrets stay as they are.

    Needs text and source; other columns, of whatever names, pass through. n_chars, where there is one, is the new
    text's length in code points for changed rows only. Null and empty texts stay; a null source is an empty path; repeated rows are changed alike; an empty table gives none.
    """
    forest = fit(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    names, at = docs.columns, f"c{place(docs, 'text')}"
    found = candidates(numbered(docs), at, f"c{place(docs, 'source')}")
    measured = found.withColumn("__scan_features", F.when(F.col("__scan_raw").isNotNull(), F.expr(f"transform({_CONTEXTS}, c -> {_features('c')})")))
    marked = measured.withColumn("__scan_secret", F.expr(f"transform(__scan_features, f -> {forest.sql([f'f.{x}' for x in FEATURES])} >= {threshold!r}D)"))
    hit = F.expr("coalesce(exists(__scan_secret, s -> s), false)")
    mark_sql = mark.replace("\\", "\\\\").replace("'", "\\'")
    clean = F.expr(f"concat_ws('', transform(__scan_parts, (p, i) -> concat(p, if(i < size(__scan_raw), if(__scan_secret[i], '{mark_sql}', __scan_raw[i]), ''))))")
    out = marked.withColumn(at, F.when(hit, clean).otherwise(F.col(at)))
    if "n_chars" in names:
        n = names.index("n_chars")
        out = out.withColumn(f"c{n}", F.when(hit, F.char_length(at).cast(docs.schema[n].dataType)).otherwise(F.col(f"c{n}")))
    return out.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
