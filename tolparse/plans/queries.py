"""One query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import catalog, frames
from ..functions import collapse_breaks, cut_out, either_case, enclosed_name, index_of, leading_count
from ..operators import baselines, batch, compare, entities, grammars, nesting, preprocess, sections, spans, trees
from ..parsing import visitors
from ..parsing.engine import Parser, compile_grammar
from ..sources import files, reports
from ..sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, small: bool = False) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out to all; tables of more partitions are left as they are.

    ``small``: of rows that are little data and much work, each partition is dealt out to 64 tasks, even if it is the only one: a file of a few MB holds millions.
    """
    cores, given = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if small:
        return scan.repartition(max(cores, 64 * given))
    return scan.repartition(cores) if given < cores else scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text")), small=True)


# Grammars for the tables at hand.

JSON = """
STRING : '"' ('\\\\' . | ~["\\\\])* '"'
NUMBER : '-'? [0-9]+ ('.' [0-9]+)?
OBJECT : %left '{' %right '}'
ARRAY : %left '[' %right ']'

value = object | array | STRING | NUMBER | 'true' | 'false' | 'null'
object = '{' members '}'
members = member (',' member)* |
member = name ':' value
name = STRING
array = '[' Any ']'

%%
%parsing start value
%nodes ghost members
"""
HTML_TEXT = """
COMMENT : '<!--' .*? '-->'
SCRIPT : '<script' ~[>]* '>' .*? '</script>'
STYLE : '<style' ~[>]* '>' .*? '</style>'
TAG : '<' ~[>]* '>'
TEXT : ~[<]+

page = (tag | Any)*
tag = TAG | COMMENT | SCRIPT | STYLE

%%
%parsing start page
%nodes leaf tag
"""
CODE = """
NOTE : '//' ~[\\n]*
ID : [A-Za-z_] [A-Za-z_0-9]*
BRACES : %left '{' %right '}'

file = item*
item = field | Any ';'
field = 'int' name ';'
name = ID

%%
%parsing {
    start file
    skip NOTE
    recovery item
}
%customblock {
    start("/// begin")
    end("/// end")
    basetoken NOTE
}
"""


CODE_LR = CODE.replace("file = item*\nitem = field | Any ';'", "file = item*\nitem = field | other\nother = Any ';'")
GROUPS = """
ID : [A-Za-z_] [A-Za-z_0-9]*

file = item*
item = field | group | Any ';'
group = 'group' AnyAvoid('int') 'end' ';'
field = 'int' ID ';'

%%
%parsing {
    start file
    recovery item
}
"""
BARS = """
WORD : [A-Za-z]+
BARS : %left '|' %right '|'

text = (WORD | Any)*

%%
%parsing start text
"""


@cache
def json_ll() -> Parser:
    return compile_grammar(JSON, "LL")


@cache
def json_lr() -> Parser:
    return compile_grammar(JSON, "LR")


@cache
def html_text() -> Parser:
    return compile_grammar(HTML_TEXT, "LL")


@cache
def code() -> Parser:
    return compile_grammar(CODE, "LL")


@cache
def code_lr() -> Parser:
    return compile_grammar(CODE_LR, "LR")


@cache
def groups() -> Parser:
    return compile_grammar(GROUPS, "LL")


@cache
def bars() -> Parser:
    return compile_grammar(BARS, "LL")


#: The words of every whole turn of the conversations, of which the queries below make code: (doc_id, nr, w). Ids are told apart for up to 2 ** 24 turns.
_TURN_WORDS = """
    SELECT doc_id, generate_subscripts(ws, 1) AS nr, unnest(ws) AS w FROM (SELECT conv_id * 16777216 + turn AS doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM conversations)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 16777216 + F.col("turn")).alias("doc_id"), "text"), small=True)


def turn_code(spark: SparkSession, sf_dir: str, piece: Callable, between: str = "") -> DataFrame:
    """For each turn the text that ``piece`` makes of its words, one after the other."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return turns(spark, sf_dir).withColumn("text", F.array_join(F.transform(words, piece), between))


# Lexing.

_WORDS = "regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')"


@query(f"SELECT doc_id, (generate_subscripts(w, 1) - 1)::INT AS tok_idx, unnest(w) AS word FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def tokenize_words(spark, sf_dir):
    return frames.tokens(documents(spark, sf_dir), catalog.grammar("words")).select("doc_id", "tok_idx", F.col("text").alias("word"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word")
def token_counts(spark, sf_dir):
    found = frames.plain_tokens(documents(spark, sf_dir), catalog.grammar("words"))
    return found.groupBy(F.col("text").alias("word")).agg(F.count("*").alias("n"))


@query("""
    SELECT doc_id, (nr - 1)::INT AS tok_idx, line FROM (
        SELECT doc_id, generate_subscripts(l, 1) AS nr, len(l) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
    WHERE nr < n OR line <> ''
""")
def tokenize_lines(spark, sf_dir):
    found = frames.tokens(documents(spark, sf_dir), catalog.grammar("lines"))
    return found.select("doc_id", "tok_idx", F.rtrim(F.col("text"), F.lit("\n")).alias("line"))


@query(r"""
    SELECT doc_id, 0 AS tok_idx, word, length(before)::INT AS start_off, (1 + length(before) - length(replace(before, chr(10), '')))::INT AS start_line, length(regexp_extract(before, '[^\n]*$'))::INT AS start_col
    FROM (SELECT conv_id * 16777216 + turn AS doc_id, regexp_extract(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+') AS word, regexp_extract(text, '^[^A-Za-zÀ-ÖØ-öø-ÿ]*') AS before FROM (SELECT conv_id, turn, chr(10) || ' ' || text AS text FROM conversations)) WHERE word <> ''
""")
def first_words(spark, sf_dir):
    """The first word of each turn, with its offset, line and column; each turn is put on a line of its own."""
    found = frames.tokens(turns(spark, sf_dir).withColumn("text", F.concat(F.lit("\n "), "text")), catalog.grammar("words")).filter("tok_idx = 0")
    return found.select("doc_id", "tok_idx", F.col("text").alias("word"), "start_off", "start_line", "start_col")


@query(f"""
    SELECT doc_id, (2 * (nr - 1) + k)::INT AS tok_idx, CASE k WHEN 0 THEN w ELSE '|' END AS token, CASE k WHEN 0 THEN (nr - 1) % 2 ELSE 1 - nr % 2 END::INT AS depth,
        CASE WHEN k = 0 THEN 'forward' WHEN nr % 2 = 1 THEN 'down' ELSE 'up' END AS direction FROM ({_TURN_WORDS}), range(2) r(k)
""")
def symmetric_pairs(spark, sf_dir):
    """A pair whose two ends look alike: each end opens what the one before closed."""
    found = frames.tokens(turn_code(spark, sf_dir, lambda w: F.concat(w, F.lit(" | "))), bars())
    return found.select("doc_id", "tok_idx", F.col("text").alias("token"), "depth", "direction")


# Nesting.

_PROPS = """regexp_extract_all(props, '"[^"]*"|-?[0-9]+(?:[.][0-9]+)?|[A-Za-z]+|[{}:,]|[^ ]')"""
_DEPTH = f"""
    SELECT doc_id, tok_idx, token,
        coalesce(sum(CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS depth,
        CASE token WHEN '{{' THEN 'down' WHEN '}}' THEN 'up' ELSE 'forward' END AS direction
    FROM (SELECT event_id AS doc_id, (generate_subscripts(w, 1) - 1)::INT AS tok_idx, unnest(w) AS token FROM (SELECT event_id, {_PROPS} AS w FROM events))
"""


@query(_DEPTH)
def pair_depth(spark, sf_dir):
    return frames.tokens(props(spark, sf_dir), json_ll()).select("doc_id", "tok_idx", F.col("text").alias("token"), "depth", "direction")


@query(_DEPTH)
def pair_depth_window(spark, sf_dir):
    found = frames.tokens(props(spark, sf_dir), json_ll()).select("doc_id", "tok_idx", F.col("text").alias("token"))
    return nesting.with_depth(found, ["{"], ["}"], "token")


@query(f"SELECT doc_id, max(depth) AS max_depth FROM ({_DEPTH}) GROUP BY doc_id")
def max_depth(spark, sf_dir):
    return frames.tokens(props(spark, sf_dir), json_ll()).groupBy("doc_id").agg(F.max("depth").alias("max_depth"))


@query(f"SELECT doc_id, tok_idx, lead(tok_idx) OVER (PARTITION BY doc_id, depth ORDER BY tok_idx) AS next_idx FROM ({_DEPTH})")
def skip_to_level(spark, sf_dir):
    return nesting.next_at_level(frames.tokens(props(spark, sf_dir), json_ll())).select("doc_id", "tok_idx", "next_idx")


@query("""
    SELECT doc_id, -least(min(run), 0)::BIGINT AS unopened, (max_by(run, nr) - least(min(run), 0))::BIGINT AS unclosed FROM (
        SELECT doc_id, nr, sum(CASE b WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY nr) AS run FROM (
            SELECT doc_id, generate_subscripts(w, 1) AS nr, unnest(w) AS b FROM (SELECT doc_id, regexp_extract_all(text, '[()]') AS w FROM documents)))
    GROUP BY doc_id
""")
def unmatched_brackets(spark, sf_dir):
    marks = documents(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([()])"), F.lit(1))).alias("tok_idx", "text"))
    return nesting.unmatched(marks, ["("], [")"])


_MARKS = """
    SELECT doc_id * 4294967296 + nr - 1 AS idx, CASE WHEN m IN ('(', ')') THEN 'round' WHEN m IN ('b', 'd') THEN 'b' ELSE 'p' END AS kind, m IN ('(', 'b', 'p') AS opens
    FROM (SELECT doc_id, generate_subscripts(ms, 1) AS nr, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all(text, '[()bdpq]') AS ms FROM documents))
"""
_BRACKETS = f"""
    WITH r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (ORDER BY idx) - CASE WHEN opens THEN 1 ELSE 0 END AS level FROM ({_MARKS})),
    b AS (SELECT *, lag(idx) OVER w AS before, lag(kind) OVER w AS kind_before, lag(opens) OVER w AS opens_before, lead(opens) OVER w AS opens_next FROM r WINDOW w AS (PARTITION BY level ORDER BY idx)),
    m AS (
        SELECT CASE WHEN opens_before THEN before END AS open_idx, CASE WHEN opens_before THEN kind_before END AS open_kind, idx AS close_idx, kind AS close_kind, level::BIGINT AS level FROM b WHERE NOT opens
        UNION ALL SELECT idx, kind, NULL, NULL, level::BIGINT FROM b WHERE opens AND coalesce(opens_next, true))
"""
_PAIRS = {"round": ("(", ")"), "b": ("b", "d"), "p": ("p", "q")}


def _one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets, and letters that look like some, of all documents, as those of one text."""
    marks = F.posexplode(F.regexp_extract_all("text", F.lit("([()bdpq])"), F.lit(1))).alias("nr", "text")
    return table(spark, sf_dir, "documents").select("doc_id", marks).select(F.lit(0).alias("doc_id"), (F.col("doc_id") * (1 << 32) + F.col("nr")).alias("tok_idx"), "text")


@query(f"{_BRACKETS} SELECT * FROM m")
def bracket_pairs(spark, sf_dir):
    """Brackets of three kinds matched over all documents as one text."""
    return nesting.brackets(_one_text(spark, sf_dir), _PAIRS, stretch=64 << 32).drop("doc_id")


@query(f"{_BRACKETS} SELECT min(close_idx) AS tok_idx, min_by(close_kind, close_idx) AS kind, min_by(coalesce(open_kind, ''), close_idx) AS expected FROM m WHERE close_idx IS NOT NULL AND (open_idx IS NULL OR open_kind <> close_kind) HAVING count(*) > 0")
def first_bracket_error(spark, sf_dir):
    found = nesting.first_errors(nesting.brackets(_one_text(spark, sf_dir), _PAIRS, stretch=64 << 32))
    return found.select("tok_idx", "kind", F.coalesce("expected", F.lit("")).alias("expected"))


@query("SELECT event_id AS doc_id, event_id % 3 = 0 AS has_error FROM events")
def pair_errors(spark, sf_dir):
    """A closer without its opener stops the parse: every third event loses its first brace."""
    broken = props(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.expr("substr(text, 2)")).otherwise(F.col("text")))
    return frames.stats(broken, json_ll()).select("doc_id", "has_error")


_BLOCK = "24 + length(w) + CASE WHEN length(w) % 2 = 0 THEN length(w) + 6 ELSE 0 END"


@query(f"""
    SELECT doc_id, w AS name, (after - size)::INT AS start_off, (after - 2)::INT AS end_off
    FROM (SELECT doc_id, w, sum({_BLOCK}) OVER (PARTITION BY doc_id ORDER BY nr) AS after, {_BLOCK} AS size FROM ({_TURN_WORDS}))
""")
def custom_blocks(spark, sf_dir):
    """Custom blocks in generated code, some with a field within."""
    piece = lambda w: F.concat(F.lit("/// begin "), w, F.lit("\n// x\n"), F.when(F.length(w) % 2 == 0, F.concat(F.lit("int "), w, F.lit(";\n"))).otherwise(""), F.lit("/// end\n"))
    return frames.blocks(turn_code(spark, sf_dir, piece), code()).select("doc_id", "name", "start_off", "end_off")


@query(f"SELECT doc_id, w AS name, (length(w) % 3)::BIGINT AS n_fields FROM ({_TURN_WORDS})")
def block_nodes(spark, sf_dir):
    """Blocks as nodes of the tree, with the fields that they hold."""
    piece = lambda w: F.concat(F.lit("/// begin "), w, F.lit("\n"), F.repeat(F.lit("int a;\n"), F.length(w) % 3), F.lit("/// end\nint b;\n"))
    nodes = frames.nodes(turn_code(spark, sf_dir, piece), code(), columns=["doc_id", "parent_id", "type", "value"], only=lambda n: n.type in ("item", "custom_block_start"))
    parts = nodes.groupBy("doc_id", "parent_id").agg(F.max(F.when(F.col("type") == "custom_block_start", F.col("value")[0])).alias("name"), F.count_if(F.col("type") == "item").alias("n_fields"))
    return parts.filter("name is not null").select("doc_id", "name", "n_fields")


# Parsing.

_TAGS = r"regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs'), '</?[A-Za-z][^>]*>')"


@query(f"""
    SELECT tag, count(*) AS n FROM (SELECT lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)) AS tag FROM (SELECT unnest({_TAGS}) AS t FROM pages)) GROUP BY tag
""")
def tag_counts(spark, sf_dir):
    found = frames.plain_tokens(pages(spark, sf_dir), catalog.grammar("html_tags")).filter(F.col("name").isin("OPEN_TAG", "CLOSE_TAG"))
    return found.groupBy(F.lower(F.regexp_extract("text", "^</?([A-Za-z0-9]+)", 1)).alias("tag")).agg(F.count("*").alias("n"))


@query(f"""
    SELECT doc_id, CASE WHEN t[2] = '/' THEN 'close_tag' ELSE 'open_tag' END AS type, count(*) AS n
    FROM (SELECT page_id AS doc_id, unnest({_TAGS}) AS t FROM pages) GROUP BY ALL
""")
def tag_entities(spark, sf_dir):
    found = frames.entities(pages(spark, sf_dir), catalog.grammar("html_tags"), ["open_tag", "close_tag"], with_errors=True)
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query(r"""
    SELECT page_id AS doc_id, len(w) AS n_water, list_sum([length(x) FOR x IN w])::BIGINT AS water_chars FROM (
        SELECT page_id, [x FOR x IN string_split(regexp_replace(html, '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', chr(1), 'gs'), chr(1)) IF x <> ''] AS w FROM pages)
    WHERE len(w) > 0
""")
def water_segments(spark, sf_dir):
    found = trees.water(frames.nodes(pages(spark, sf_dir), html_text(), columns=["doc_id", "node_id", "symbol", "start_off", "end_off"], only=lambda n: n.symbol == "Any"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_water"), F.sum(F.col("end_off") - F.col("start_off") + 1).alias("water_chars"))


_KEYS = """SELECT event_id AS doc_id, '"' || unnest(json_keys(props)) || '"' AS value FROM events"""


@query(_KEYS)
def ll_parse_json(spark, sf_dir):
    return frames.entities(props(spark, sf_dir), json_ll(), ["member"]).select("doc_id", "value")


@query(_KEYS)
def lr_parse_json(spark, sf_dir):
    return frames.entities(props(spark, sf_dir), json_lr(), ["member"]).select("doc_id", "value")


@query(_KEYS)
def entities_from_nodes(spark, sf_dir):
    """The same from a nodes table, relationally."""
    nodes = frames.nodes(props(spark, sf_dir), json_ll(), columns=["doc_id", "node_id", "last_desc", "parent_id", "type", "alias", "symbol", "value"])
    return entities.select_entities(nodes, ["member"]).select("doc_id", "value")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field for each word, but without its name if the word's length is a multiple of three."""
    return turn_code(spark, sf_dir, lambda w: F.when(F.length(w) % 3 == 0, "int ;").otherwise(F.concat(F.lit("int "), w, F.lit(";"))), " ")


_RECOVERY = f"SELECT conv_id * 16777216 + turn AS doc_id, len([w FOR w IN regexp_extract_all(text, '[A-Za-z]+') IF length(w) % 3 = 0])::BIGINT AS recovery_times, false AS has_error FROM conversations"


@query(_RECOVERY)
def recovery(spark, sf_dir):
    """Where a field lacks its name, the parser takes it for water and goes on behind it."""
    return frames.stats(_statements(spark, sf_dir), code()).select("doc_id", "recovery_times", "has_error")


@query(_RECOVERY)
def lr_recovery(spark, sf_dir):
    return frames.stats(_statements(spark, sf_dir), code_lr()).select("doc_id", "recovery_times", "has_error")


@query(f"{_RECOVERY} ORDER BY recovery_times DESC, doc_id LIMIT 5")
def topk_recovery(spark, sf_dir):
    found = entities.top(frames.stats(_statements(spark, sf_dir), code()), "recovery_times")
    return found.select("doc_id", "recovery_times", "has_error")


@query(f"""
    SELECT doc_id, (sum(CASE WHEN length(w) % 3 = 0 THEN 6 ELSE 6 + length(w) END) OVER (PARTITION BY doc_id ORDER BY nr) - 2)::INT AS offset,
        length(w) % 3 = 0 AS broken FROM ({_TURN_WORDS}) QUALIFY length(w) % 3 = 0
""")
def parse_messages(spark, sf_dir):
    """Where the parser met an unexpected token: the ends of fields without a name."""
    found = frames.messages(_statements(spark, sf_dir), code()).filter("text = 'unexpected token'")
    return found.select("doc_id", "offset", ((F.col("unexpected_lexeme") == ";") & (F.col("line") == 1) & (F.col("col") == F.col("offset"))).alias("broken"))


@query(f"""
    SELECT doc_id, count(*) FILTER (length(w) % 2 = 0) AS recovery_times_any, coalesce(max(length(w) % 5) FILTER (length(w) % 2 = 0), 0)::BIGINT AS longest_rollback FROM ({_TURN_WORDS}) GROUP BY doc_id
""")
def rollbacks(spark, sf_dir):
    """Water that meets what it must avoid is given back, and taken anew by an outer rule."""
    piece = lambda w: F.concat(F.lit("group "), F.repeat(F.lit("x "), F.length(w) % 5), F.when(F.length(w) % 2 == 0, "int y; ").otherwise("end; "))
    return frames.stats(turn_code(spark, sf_dir, piece).filter("text <> ''"), groups()).select("doc_id", "recovery_times_any", "longest_rollback")


@query("SELECT conv_id * 16777216 + turn AS doc_id, len([w FOR w IN regexp_extract_all(text, '[A-Za-z]+') IF length(w) % 3 = 0]) > 0 AS has_error FROM conversations")
def water_as_error(spark, sf_dir):
    """Water that counts as an error, though parsing goes on behind it."""
    parser = compile_grammar(CODE.replace("Any ';'", "AnyError ';'"), "LL")
    return frames.stats(_statements(spark, sf_dir), parser).select("doc_id", "has_error")


_WATERS = ("Any", "AnyIgnorePairs", "AnyInclude('!')", "AnyExcept(';')")


def _item_parser(water: str) -> Parser:
    """Items of a text of ``(w; w); [w! w];`` for each word."""
    return compile_grammar(f"WORD : [A-Za-z]+\nROUND : %left '(' %right ')'\nSQUARE : %left '[' %right ']'\n\ntext = item*\nitem = {water} ';' | '!'\n\n%%\n%parsing start text", "LL")


@query(f"""
    SELECT doc_id, 2 * count(*) AS "Any", 3 * count(*) AS "AnyIgnorePairs", 2 * count(*) AS "AnyInclude", 2 * count(*) AS "AnyExcept" FROM ({_TURN_WORDS}) GROUP BY doc_id
""")
def water_forms(spark, sf_dir):
    """Wildcards that step over pairs or into them, that take what could follow, or that stop at nothing else."""
    docs = turn_code(spark, sf_dir, lambda w: F.concat(F.lit("("), w, F.lit("; "), w, F.lit("); ["), w, F.lit("! "), w, F.lit("]; ")))
    names = [w.split("(")[0] for w in _WATERS]
    found = frames.node_counts(docs, dict(zip(names, map(_item_parser, _WATERS), strict=True)), "item")
    counts = found.groupBy("doc_id").agg(*(F.sum(n).alias(n) for n in names))
    return counts.filter(F.least(*names) > 0)


# Trees: each customer with the years of their orders and the orders below these, in pre-order.

_TREE = """
    WITH n AS (
        SELECT c_custkey AS doc_id, 'customer' AS symbol, c_name AS name, -1 AS a, -1::BIGINT AS b FROM customer
        UNION ALL SELECT DISTINCT o_custkey, 'year', year(o_orderdate)::VARCHAR, year(o_orderdate), -1 FROM orders
        UNION ALL SELECT o_custkey, 'order', 'o' || o_orderkey, year(o_orderdate), o_orderkey FROM orders),
    t AS (
        SELECT doc_id, symbol, name, a, b, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::INT AS node_id,
            (CASE symbol WHEN 'customer' THEN count(*) OVER (PARTITION BY doc_id) ELSE count(*) OVER (PARTITION BY doc_id, a) END)::INT AS size FROM n SEMI JOIN customer ON doc_id = c_custkey),
    tree AS (
        SELECT doc_id, node_id, symbol, name, a, CASE symbol WHEN 'order' THEN node_id ELSE node_id + size - 1 END AS last_desc,
            CASE symbol WHEN 'customer' THEN NULL WHEN 'year' THEN 0 ELSE min(node_id) OVER (PARTITION BY doc_id, a) END AS parent_id FROM t)
"""


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    orders = orders.join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"))
    rows = lambda df, doc, symbol, name, a, b: df.select(F.col(doc).cast("long").alias("doc_id"), F.lit(symbol).alias("symbol"), name.cast("string").alias("name"), a.cast("int").alias("a"), b.cast("long").alias("b"))
    n = rows(customers, "c_custkey", "customer", F.col("c_name"), F.lit(-1), F.lit(-1)).unionByName(rows(orders.select("o_custkey", "year").distinct(), "o_custkey", "year", F.col("year"), F.col("year"), F.lit(-1)))
    n = n.unionByName(rows(orders, "o_custkey", "order", F.concat(F.lit("o"), "o_orderkey"), F.col("year"), F.col("o_orderkey")))
    own, group = W.Window.partitionBy("doc_id"), W.Window.partitionBy("doc_id", "a")
    n = n.withColumn("node_id", (F.row_number().over(own.orderBy("a", "b")) - 1).cast("int"))
    size = F.when(F.col("symbol") == "customer", F.count("*").over(own)).otherwise(F.count("*").over(group))
    n = n.withColumn("last_desc", F.when(F.col("symbol") == "order", F.col("node_id")).otherwise(F.col("node_id") + size - 1).cast("int"))
    parent = F.when(F.col("symbol") == "year", F.lit(0)).when(F.col("symbol") == "order", F.min("node_id").over(group)).cast("int")
    return n.select("doc_id", "node_id", "last_desc", parent.alias("parent_id"), F.lit(0).alias("child_idx"), "symbol", "name", "a", F.array("name").alias("value"))


@query(f"{_TREE} SELECT doc_id, node_id, symbol FROM tree WHERE symbol = 'customer' OR a % 2 = 1")
def void_subtrees(spark, sf_dir):
    return trees.drop_subtrees(customer_trees(spark, sf_dir), (F.col("symbol") == "year") & (F.col("a") % 2 == 0)).select("doc_id", "node_id", "symbol")


@query(f"""{_TREE} SELECT doc_id, node_id, CASE WHEN symbol = 'customer' THEN NULL ELSE 0 END AS parent_id,
    CASE WHEN symbol = 'customer' THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, symbol = 'customer' ORDER BY node_id) - 1 END::INT AS child_idx FROM tree WHERE symbol <> 'year'""")
def ghost_splice(spark, sf_dir):
    return trees.splice(customer_trees(spark, sf_dir), F.col("symbol") == "year").select("doc_id", "node_id", "parent_id", "child_idx")


@query(f"""{_TREE} SELECT doc_id, node_id, CASE WHEN symbol = 'customer' THEN NULL WHEN a % 2 = 0 AND symbol = 'order' THEN 0 ELSE parent_id END AS parent_id
    FROM tree WHERE NOT (symbol = 'year' AND a % 2 = 0)""")
def list_flatten(spark, sf_dir):
    """Even years are lists within their customer's list."""
    tree = customer_trees(spark, sf_dir).withColumn("symbol", F.when((F.col("symbol") == "customer") | (F.col("symbol") == "year") & (F.col("a") % 2 == 0), "list").otherwise(F.col("symbol")))
    return trees.flatten_lists(tree, ["list"]).select("doc_id", "node_id", "parent_id")


@query(f"""{_TREE} SELECT doc_id, min(node_id) AS node_id, CASE WHEN a = -1 THEN min(name) ELSE string_agg(name, '' ORDER BY node_id) END AS text FROM tree GROUP BY doc_id, a""")
def leaf_collapse(spark, sf_dir):
    return trees.collapse_leaves(customer_trees(spark, sf_dir), ["year"]).select("doc_id", "node_id", F.array_join("value", "").alias("text"))


@query(f"{_TREE} SELECT d.doc_id, d.node_id, a.node_id AS ancestor_id FROM tree d JOIN tree a ON d.doc_id = a.doc_id AND d.node_id > a.node_id AND d.node_id <= a.last_desc")
def ancestor_pairs(spark, sf_dir):
    return trees.ancestors(customer_trees(spark, sf_dir))


#: Sentences without the white space before them: the leaves of a document's root; its lines are blocks.
_LEAVES = r"""
    SELECT doc_id, (s + length(x) - length(regexp_replace(x, '^\s+', '')))::INT AS s, (s + length(x) - 1)::INT AS e FROM (
        SELECT doc_id, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT doc_id, generate_subscripts(t, 1) AS nr, unnest(t) AS x FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*|[.!?]+') AS t FROM documents)))
    WHERE regexp_replace(x, '^\s+', '') <> ''
"""
_LINE_BLOCKS = """
    SELECT doc_id, s, e, size FROM (
        SELECT doc_id, (coalesce(sum(length(x) + 1) OVER w, 0))::INT AS s, (coalesce(sum(length(x) + 1) OVER w, 0) + length(x) - 1)::INT AS e, size
        FROM (SELECT doc_id, length(text) AS size, generate_subscripts(t, 1) AS nr, unnest(t) AS x FROM (SELECT doc_id, text, string_split(text, chr(10)) AS t FROM documents))
        WINDOW w AS (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE e >= s
"""
_CUTTING = f"""
    SELECT DISTINCT b.doc_id, b.s FROM ({_LINE_BLOCKS}) b JOIN ({_LEAVES}) l ON b.doc_id = l.doc_id AND l.s <= b.e AND l.e >= b.s AND (l.s < b.s OR l.e > b.e)
"""


def _leaves_and_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tree for each document, the whole text with its sentences below it, and the lines as blocks."""
    docs = documents(spark, sf_dir).filter("text <> ''")
    found = preprocess.excluded_by_pattern(docs, r"[^.!?\s][^.!?]*[.!?]*|[.!?]+")
    own = W.Window.partitionBy("doc_id")
    leaves = found.withColumn("node_id", F.row_number().over(own.orderBy("start_off")).cast("int"))
    root = docs.select("doc_id", F.lit(0).alias("start_off"), (F.length("text") - 1).alias("end_off"), F.lit(0).alias("node_id"))
    both = root.unionByName(leaves).withColumn("last_desc", F.when(F.col("node_id") == 0, (F.count("*").over(own) - 1).cast("int")).otherwise(F.col("node_id")))
    kind, parent = F.when(F.col("node_id") == 0, "text").otherwise("sentence"), F.when(F.col("node_id") > 0, F.lit(0))
    nodes = both.select(
        "doc_id", "node_id", "last_desc", parent.alias("parent_id"), F.greatest(F.col("node_id") - 1, F.lit(0)).alias("child_idx"), F.coalesce(parent + 1, F.lit(0)).alias("level"), kind.alias("symbol"), kind.alias("type"),
        F.array().cast("array<string>").alias("value"), "start_off", "end_off",
    )
    lines = preprocess.excluded_by_pattern(docs, r"[^\n]+")
    edges = {"block_id": F.col("start_off"), "name": F.lit("line"), "head_end": F.col("start_off"), "tail_start": F.col("end_off"), "start_line": F.lit(1), "end_line": F.lit(1)}
    return nodes, lines.withColumns(edges)


@query(f"""
    SELECT b.doc_id, b.s AS start_off, CASE WHEN b.s = 0 AND b.e = b.size - 1 THEN 1 ELSE (SELECT count(*) FROM ({_LEAVES}) l WHERE l.doc_id = b.doc_id AND b.s <= l.s AND l.e <= b.e) END AS n
    FROM ({_LINE_BLOCKS}) b ANTI JOIN ({_CUTTING}) c ON b.doc_id = c.doc_id AND b.s = c.s AND NOT (b.s = 0 AND b.e = b.size - 1)
""")
def blocks_inserted(spark, sf_dir):
    """Lines as nodes around the sentences that they hold (or around the root), and how many."""
    nodes = trees.insert_blocks(*_leaves_and_blocks(spark, sf_dir))
    held = nodes.filter(~F.col("symbol").startswith("custom_block")).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    blocks = nodes.filter("symbol = 'custom_block'").select("doc_id", "node_id", "start_off")
    return blocks.join(held, ["doc_id", "node_id"], "left").select("doc_id", "start_off", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{_CUTTING}".replace("b.doc_id, b.s FROM", "b.doc_id, b.s AS start_off FROM", 1))
def blocks_that_cut(spark, sf_dir):
    """Lines that cut a sentence, or stand within one."""
    return trees.cutting_blocks(*_leaves_and_blocks(spark, sf_dir)).select("doc_id", "start_off")


_LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS nr, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"""
    SELECT doc_id, min(nr)::INT AS nr, string_agg(line, '' ORDER BY nr) AS text FROM (
        SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY nr) AS island FROM (
            SELECT *, CASE WHEN length(line) % 2 = 0 AND line <> '' AND coalesce(lag(length(line) % 2 = 0) OVER (PARTITION BY doc_id ORDER BY nr), false) THEN 0 ELSE 1 END AS begins FROM ({_LINES})))
    GROUP BY doc_id, island
""")
def merge_water(spark, sf_dir):
    """Lines of even length are water, and merge."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("nr", "line"))
    rows = rows.select("doc_id", "nr", F.array("line").alias("value"), F.col("nr").alias("start_off"), F.col("nr").alias("end_off"), F.length("line").alias("n"))
    merged = trees.merge_adjacent(rows, ["doc_id"], "nr", F.col("n") % 2 == 0, F.col("n") == 0)
    return merged.select("doc_id", "nr", F.array_join("value", "").alias("text"))


# Segments.

_SPANS = "SELECT l_orderkey, l_linenumber, l_quantity::INT AS s1, l_quantity::INT + 3 * l_linenumber AS e1, (l_suppkey % 50)::INT AS s2, (l_suppkey % 50)::INT + round(l_discount * 100)::INT AS e2 FROM lineitem"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, s2 = F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 50).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s1.alias("s1"), (s1 + 3 * F.col("l_linenumber")).alias("e1"), s2.alias("s2"), (s2 + F.round(F.col("l_discount") * 100).cast("int")).alias("e2"))



def _four() -> list:
    return [F.col(c) for c in ("s1", "e1", "s2", "e2")]


@query(f"SELECT l_orderkey, l_linenumber, s1 <= s2 AND e1 >= e2 AS includes, (s1 <= s2 AND s2 <= e1) <> (s1 <= e2 AND e2 <= e1) AS overlaps FROM ({_SPANS})")
def span_relations(spark, sf_dir):
    return segments(spark, sf_dir).select("l_orderkey", "l_linenumber", spans.includes(*_four()).alias("includes"), spans.overlaps(*_four()).alias("overlaps"))


@query(f"""SELECT l_orderkey, l_linenumber, least(s1, s2) AS start_off, greatest(e1, e2) AS end_off, greatest(e1, e2) - least(s1, s2) + 1 AS size FROM ({_SPANS})""")
def span_hull(spark, sf_dir):
    both = segments(spark, sf_dir).withColumn("h", spans.hull(*_four()))
    return both.select("l_orderkey", "l_linenumber", "h.start_off", "h.end_off", spans.length(F.col("h.start_off"), F.col("h.end_off")).alias("size"))


@query(f"""
    SELECT l_orderkey, l_linenumber, s1 AS start_off, CASE WHEN s2 > e1 OR e2 < s1 THEN e1 ELSE s2 - 1 END AS end_off FROM ({_SPANS}) WHERE s2 > e1 OR e2 < s1 OR s1 < s2
    UNION ALL SELECT l_orderkey, l_linenumber, e2 + 1, e1 FROM ({_SPANS}) WHERE s2 <= e1 AND e2 >= s1 AND e1 > e2
""")
def span_exclude(spark, sf_dir):
    left = segments(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(spans.exclude(*_four())).alias("x"))
    return left.select("l_orderkey", "l_linenumber", "x.start_off", "x.end_off")


@query(f"SELECT l_orderkey, l_linenumber, s1 AS start_off, e2 AS end_off, greatest(s1 - 20, 0) AS moved, greatest(l_linenumber - 3, 1)::INT AS line FROM ({_SPANS}) WHERE s1 <= s2")
def span_merge(spark, sf_dir):
    """From the first segment's start to the second one's end; a start moved back by 20, and a line by 3, as far as they go."""
    both = segments(spark, sf_dir).filter("s1 <= s2").withColumn("m", spans.merge(F.col("s1"), F.col("e2")))
    return both.select("l_orderkey", "l_linenumber", "m.start_off", "m.end_off", spans.shift(F.col("s1"), F.lit(-20)).alias("moved"), spans.shift_line(F.col("l_linenumber"), F.lit(-3)).cast("int").alias("line"))


_TILES = "SELECT doc_id, generate_subscripts(t, 1) AS nr, t, unnest(t) AS x FROM (SELECT doc_id, {0} AS t FROM documents)"
_SENTENCES = f"""
    SELECT doc_id, (coalesce(sum(length(x)) OVER before, 0))::INT AS s, (coalesce(sum(length(x)) OVER before, 0) + length(x) - 1)::INT AS e
    FROM ({_TILES.format("regexp_extract_all(text, '[^.!?]+[.!?]*|[.!?]+')")}) WINDOW before AS (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
_LINE_SPANS = f"""
    SELECT * FROM (SELECT doc_id, (coalesce(sum(length(x) + 1) OVER before, 0))::INT AS s, (coalesce(sum(length(x) + 1) OVER before, 0) + length(x) - 1)::INT AS e
    FROM ({_TILES.format("string_split(text, chr(10))")}) WINDOW before AS (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE e >= s
"""


def _lines_and_sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines and the sentences of whole documents, as segments."""
    docs = documents(spark, sf_dir)
    return tuple(preprocess.excluded_by_pattern(docs, p) for p in (r"[^\n]+", r"[^.!?]+[.!?]*|[.!?]+"))


@query(f"SELECT l.doc_id, l.s AS line, t.s AS start_off, t.e AS end_off FROM ({_LINE_SPANS}) l JOIN ({_SENTENCES}) t ON l.doc_id = t.doc_id AND l.s <= t.s AND l.e >= t.e")
def sentences_in_lines(spark, sf_dir):
    """The sentences that stand within a line."""
    found = spans.matches(*_lines_and_sentences(spark, sf_dir), "includes")
    return found.select("doc_id", F.col("left.start_off").alias("line"), "right.start_off", "right.end_off")


@query(f"SELECT t.doc_id, t.s AS start_off, l.s AS line FROM ({_SENTENCES}) t JOIN ({_LINE_SPANS}) l ON l.doc_id = t.doc_id AND (t.s <= l.s AND l.s <= t.e) <> (t.s <= l.e AND l.e <= t.e)")
def sentences_across_lines(spark, sf_dir):
    """The sentences that hold just one end of a line."""
    lines, sentences = _lines_and_sentences(spark, sf_dir)
    return spans.matches(sentences, lines, "overlaps").select("doc_id", "left.start_off", F.col("right.start_off").alias("line"))


# Preprocessing.

_CUT = "<script[^>]*>.*?</script>|<!--.*?-->"


@query(f"SELECT page_id AS doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '{_CUT}', '', 'gs') AS t FROM pages)")
def exclude_segments(spark, sf_dir):
    return preprocess.without_pattern(pages(spark, sf_dir), _CUT).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_PLACES = """
    SELECT page_id AS doc_id, nr, (list_sum([length(x) FOR x IN p[:nr]]) + 3 * (nr - 1))::INT AS off
    FROM (SELECT page_id, p, unnest(range(1, len(p))) AS nr FROM (SELECT page_id, string_split({text}, '<p>') AS p FROM pages))
"""


@query(f"""
    SELECT a.doc_id, a.off AS start_off, b.off AS whole_off FROM ({_PLACES.format(text=f"regexp_replace(html, '{_CUT}', '', 'gs')")}) a
    JOIN ({_PLACES.format(text="html")}) b ON a.doc_id = b.doc_id AND a.nr = b.nr
""")
def remap_offsets(spark, sf_dir):
    """Places of paragraphs in the texts without scripts and comments, and in the whole texts; every cut is given twice."""
    docs = pages(spark, sf_dir)
    cuts = preprocess.excluded_by_pattern(docs, _CUT)
    found = preprocess.excluded_by_pattern(preprocess.without_pattern(docs, _CUT), "<p>").select("doc_id", "start_off")
    return preprocess.remap(found, cuts.unionByName(cuts))


_LINE = "1 + length({0}) - length(replace({0}, chr(10), ''))"


@query(rf"""
    SELECT doc_id, (length(text) - 1)::INT AS start_off, ({_LINE.format("text")})::INT AS line, (length(regexp_extract(text, '[^\n]*$')) - 1)::INT AS col FROM documents WHERE text <> '' AND text NOT LIKE '%' || chr(10)
""")
def located_ends(spark, sf_dir):
    """Line and column of the last character of each document that does not end a line."""
    docs = documents(spark, sf_dir)
    ends = docs.filter((F.col("text") != "") & ~F.endswith("text", F.lit("\n"))).select("doc_id", (F.length("text") - 1).alias("start_off"))
    return preprocess.located(ends, docs)


@query(f"SELECT doc_id, string_agg(CASE WHEN length(w) % 2 = 0 THEN w ELSE 'other' END, ' ' ORDER BY nr) AS kept, count(*) AS n_cuts FROM ({_TURN_WORDS}) GROUP BY doc_id")
def conditional_compilation(spark, sf_dir):
    """Each word is defined, or not, and with it what is compiled."""
    switch = lambda w: F.when(F.length(w) % 2 == 0, "#define A\n").otherwise("#undef A\n")
    docs = turn_code(spark, sf_dir, lambda w: F.concat(switch(w), F.lit("#if A && !B || C\n"), w, F.lit("\n#elif B\nnever\n#else\nother\n#endif\n"))).filter("text <> ''")
    kept = preprocess.conditional(catalog.grammar("csharp_directives")).before(docs)
    lines = F.filter(F.split("text", "\n"), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return kept.select("doc_id", F.array_join(lines, " ").alias("kept"), F.size("cuts").cast("long").alias("n_cuts"))


@query(f"SELECT doc_id, string_agg(CASE WHEN length(w) % 2 = 0 THEN w ELSE 'other' END, ' ' ORDER BY nr) AS kept FROM ({_TURN_WORDS}) GROUP BY doc_id")
def pascal_conditionals(spark, sf_dir):
    switch = lambda w: F.when(F.length(w) % 2 == 0, "{$define A}").otherwise("{$undef A}")
    docs = turn_code(spark, sf_dir, lambda w: F.concat(switch(w), F.lit("{$ifdef A}"), w, F.lit(" {$else}other {$endif}"))).filter("text <> ''")
    kept = preprocess.conditional(catalog.grammar("pascal_directives")).before(docs)
    return kept.select("doc_id", F.rtrim(F.regexp_replace("text", r"\{\$[^}]*\}", "")).alias("kept"))


@query("""
    SELECT a.user_id AS doc_id, a.event_id AS seq, max(b.event_id)::INT AS parent_seq FROM events a
    LEFT JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.event_id * 7 % 23 < a.event_id * 7 % 23 GROUP BY ALL
""")
def section_parents(spark, sf_dir):
    heads = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 23 + 1).alias("level"))
    return sections.enclosing(heads).select("doc_id", "seq", "parent_seq")


_HEADERS = f"SELECT doc_id, nr, w, length(w) % 4 + 1 AS level, coalesce(lag(length(w) % 4 + 1) OVER (PARTITION BY doc_id ORDER BY nr), 0) AS above FROM ({_TURN_WORDS})"


@query(f"""
    WITH h AS (SELECT *, sum(greatest(level - above, 1)) OVER (PARTITION BY doc_id ORDER BY nr) AS last FROM ({_HEADERS}))
    SELECT doc_id, (last - 1 - (level - l))::INT AS section_id, l::INT AS level, CASE WHEN l = level THEN w END AS title FROM (SELECT *, unnest(range(least(above + 1, level), level + 1)) AS l FROM h)
""")
def section_hierarchy(spark, sf_dir):
    """Headers of generated Markdown, one for each word; sections of the levels that a header skips are made up."""
    text = turn_code(spark, sf_dir, lambda w: F.concat(F.repeat(F.lit("#"), (F.length(w) % 4 + 1).cast("int")), F.lit(" "), w, F.lit("\nsome text\n\n")))
    nodes = frames.nodes(text, catalog.grammar("markdown"), columns=["doc_id", "node_id", "type", "value", "start_off", "end_off"], only=lambda n: n.symbol == "block")
    blocks = nodes.select("doc_id", F.col("node_id").alias("seq"), "type", F.array_join("value", "").alias("value"), "start_off", "end_off")
    return sections.sections(blocks).select("doc_id", "section_id", "level", "title")


@query(f"""
    SELECT doc_id, type, count(*) AS n FROM (SELECT doc_id, CASE length(w) % 5 WHEN 0 THEN 'setext_heading_1' WHEN 1 THEN 'setext_heading_2' WHEN 2 THEN 'atx_heading' WHEN 3 THEN 'code' ELSE 'list_item' END AS type FROM ({_TURN_WORDS})) GROUP BY ALL
""")
def markdown_blocks(spark, sf_dir):
    kinds = lambda w: [F.concat(w, F.lit("\n===\n")), F.concat(w, F.lit("\n---\n")), F.concat(F.lit("## "), w, F.lit("\n")), F.concat(F.lit("~~~\n# "), w, F.lit("\n~~~\n")), F.concat(F.lit("* "), w, F.lit("\n"))]
    text = turn_code(spark, sf_dir, lambda w: F.element_at(F.array(*kinds(w)), F.length(w) % 5 + 1), "\n")
    found = frames.entities(text, catalog.grammar("markdown"), ["setext_heading_1", "setext_heading_2", "atx_heading", "code", "list_item"])
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("""
    SELECT o_custkey AS doc_id, seq, max(CASE WHEN h THEN seq END) OVER (PARTITION BY o_custkey, run ORDER BY seq) AS routine_seq FROM (
        SELECT *, sum(CASE WHEN other THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY seq) AS run FROM (
            SELECT o_custkey, o_orderkey AS seq, o_orderstatus = 'F' AS h, o_orderstatus = 'P' AS other FROM orders))
    WHERE NOT other
""")
def routine_aggregation(spark, sf_dir):
    """Orders as routine headers (F), what is attached to them (O), and breaks (P)."""
    kind = F.when(F.col("o_orderstatus") == "F", "routine").when(F.col("o_orderstatus") == "P", "other").otherwise("block")
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("parent_id"), F.col("o_orderkey").alias("seq"), kind.alias("type"))
    return sections.attach_to_routines(parts).filter("type <> 'other'").select("doc_id", "seq", "routine_seq")


# Reports.


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'first' ELSE p_brand END AS type FROM part")
def rename_types(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("type"))
    return compare.rename_types(parts, {"Brand#11": "first", "Brand#12": "first"})


@query("""
    SELECT doc_id, type, array_to_string(w[k + 1 : k + 2], ' ') AS value FROM (
        SELECT doc_id, type, w, unnest(range(0, len(w), 2)) AS k FROM (
            SELECT s_suppkey AS doc_id, 'name' AS type, [x FOR x IN string_split(replace(s_name, '#', ' a  b '), ' ') IF x <> ''] AS w FROM supplier))
    UNION ALL SELECT n_nationkey::BIGINT, 'nation', n_name FROM nation
""")
def chunk_values(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("name").alias("type"), F.replace("s_name", F.lit("#"), F.lit(" a  b ")).alias("value"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("nation").alias("type"), F.col("n_name").alias("value"))
    return compare.chunk_values(suppliers.unionByName(nations), {"name": 2})


_BAGS = ("SELECT c_nationkey AS value FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS value FROM supplier UNION ALL SELECT n_nationkey + 20 FROM nation")


def bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("value"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("value"))
    return left, right.union(table(spark, sf_dir, "nation").select(F.col("n_nationkey") + 20))


@query(f"({_BAGS[0]}) EXCEPT ALL ({_BAGS[1]})")
def multiset_diff_left(spark, sf_dir):
    return compare.difference(*bags(spark, sf_dir))[0]


@query(f"({_BAGS[1]}) EXCEPT ALL ({_BAGS[0]})")
def multiset_diff_right(spark, sf_dir):
    return compare.difference(*bags(spark, sf_dir))[1]


_NAIVE = "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '</?[A-Za-z][^>]*>')) AS value FROM pages"


@query(f"({_NAIVE}) EXCEPT ALL (SELECT page_id AS doc_id, unnest({_TAGS}) AS value FROM pages)")
def only_naive_tags(spark, sf_dir):
    """Tags that a plain pattern sees and the tolerant grammar does not: those inside scripts, styles and comments."""
    nodes = frames.nodes(pages(spark, sf_dir), catalog.grammar("html_tags"), columns=["doc_id", "value"], only=lambda n: n.symbol in ("open_tag", "close_tag"))
    parsed = nodes.select("doc_id", F.array_join("value", "").alias("value"))
    naive = pages(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(</?[A-Za-z][^>]*>)"), F.lit(1))).alias("value"))
    return compare.difference(naive, parsed)[0]


@query("""
    SELECT coalesce(a.k, b.k) AS doc_id, coalesce(a.n, 0)::BIGINT AS n_left, coalesce(b.n, 0)::BIGINT AS n_right
    FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON a.k = b.k
""")
def full_outer_files(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"))
    right = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("doc_id"))
    return compare.by_file(left, right, ("doc_id",))


@query("""
    SELECT prefix, min(path) AS first, max(path) AS second FROM (SELECT regexp_extract(path, '^(.*)_[^_]*$', 1) AS prefix, path FROM (
        SELECT 'out/' || n_name || CASE k WHEN 0 THEN '_tolerant' ELSE '_baseline' END AS path FROM nation, range(2) r(k) WHERE n_nationkey % 3 <> 0 OR k = 0)) GROUP BY prefix HAVING count(*) = 2
""")
def report_pairs(spark, sf_dir):
    both = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.array(F.lit("_tolerant"), F.lit("_baseline"))).alias("kind"))
    paths = both.filter("n_nationkey % 3 <> 0 or kind = '_tolerant'").select(F.concat(F.lit("out/"), "n_name", "kind").alias("path"))
    return compare.report_pairs(paths)


# Files.

#: Tasks put their many small files in place themselves; else the driver moves one after the other.
_AT_ONCE = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


@query("SELECT doc_id, text FROM documents")
def files_read(spark, sf_dir):
    """Documents written as files of four charsets, with marks and without, in two levels of folders, and read back by two patterns."""
    top = shared_folder(spark, "files")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", F.lit("\n")).alias("text")), small=True)
    docs = docs.withColumn("charset", F.pmod("doc_id", F.lit(5)))
    for nr, (name, mark, end) in enumerate((("UTF-8", "", "\n"), ("UTF-8", "EFBBBF", "\n"), ("UTF-16LE", "FFFE", "\0"), ("UTF-16BE", "", "\n"), ("UTF-32", "0000FEFF", "\n"))):
        raw = F.concat(F.unhex(F.lit(mark)), F.encode("text", name))  # the writer itself adds the last byte
        docs.filter(F.col("charset") == nr).withColumn("raw", raw).select(F.expr("substring(raw, 1, length(raw) - 1)").cast("string").alias("value"), "lang", "doc_id").write.option("lineSep", end).option(*_AT_ONCE).partitionBy("lang", "doc_id").text(f"{top}/{nr}")
    read = files.read_files(spark, [f"{top}/[0-1]", f"{top}/[2-4]/lang=*"], "*.text, *.txt")
    return read.select(F.regexp_extract("path", r"/doc_id=(\d+)/", 1).cast("long").alias("doc_id"), F.regexp_replace("text", r"\n\z", "").alias("text"))


# Statistics.

_STATS = f"SELECT doc_id, length(text)::BIGINT AS chars_count, len({_WORDS})::BIGINT AS tokens_count FROM documents"


@query(f"{_STATS} ORDER BY tokens_count DESC, doc_id LIMIT 5")
def topk_docs(spark, sf_dir):
    found = entities.top(frames.stats(documents(spark, sf_dir), catalog.grammar("words")), "tokens_count")
    return found.select("doc_id", "chars_count", "tokens_count")


@query(f"SELECT sum(chars_count)::BIGINT AS chars_count, sum(tokens_count)::BIGINT AS tokens_count, 0::BIGINT AS recovery_times, 0::BIGINT AS longest_rollback, 0::BIGINT AS recovery_times_any FROM ({_STATS})")
def stats_fold(spark, sf_dir):
    return entities.fold_stats(frames.stats(documents(spark, sf_dir), catalog.grammar("words")))


_AS_STATS = "o_custkey AS tokens_count, o_orderkey % 7 AS recovery_times, o_orderkey % 11 AS longest_rollback, o_custkey % 13 AS recovery_times_any"


@query(f"SELECT sum(tokens_count)::BIGINT AS tokens_count, sum(recovery_times)::BIGINT AS recovery_times, sum(longest_rollback)::BIGINT AS longest_rollback, max(recovery_times_any)::BIGINT AS recovery_times_any FROM (SELECT {_AS_STATS} FROM orders)")
def stats_fold_compat(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(*(x.strip() for x in _AS_STATS.split(",")))
    return entities.fold_stats(rows, reference_compat=True)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event's properties without their first brace."""
    return props(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.expr("substr(text, 2)")).otherwise(F.col("text")))


@query("SELECT event_id AS doc_id FROM events WHERE event_id % 3 <> 0")
def error_split(spark, sf_dir):
    return entities.split_by_outcome(frames.outcomes(_broken(spark, sf_dir), json_ll()))[0].select("doc_id")


# A batch: one parse, all outputs.

_EVENT_STATS = f"SELECT event_id, event_id % 3 = 0 AS failed, length(props)::BIGINT AS chars_count, len({_PROPS})::BIGINT AS tokens_count, json_keys(props) AS keys FROM events"


def _batch(spark: SparkSession, sf_dir: str) -> batch.Batch:
    docs = _broken(spark, sf_dir).withColumn("path", F.concat(F.lit("events/"), "doc_id"))
    return batch.run(docs, json_ll(), ["member"], shared_folder(spark, "batch"))


@query(f"""
    SELECT count(*) AS documents, count(*) FILTER (failed) AS failed, coalesce(sum(chars_count) FILTER (NOT failed), 0)::BIGINT AS chars_count, coalesce(sum(tokens_count) FILTER (NOT failed), 0)::BIGINT AS tokens_count,
        0::BIGINT AS recovery_times, 0::BIGINT AS recovery_times_any, 0::BIGINT AS longest_rollback FROM ({_EVENT_STATS})
""")
def batch_totals(spark, sf_dir):
    """The totals that come with the write of a batch."""
    return _batch(spark, sf_dir).totals_frame().drop("general_ms", "recovery_ms")


@query(f"""
    WITH s AS ({_EVENT_STATS})
    SELECT 'count' AS part, 'member' AS name, sum(len(keys))::BIGINT AS n FROM s WHERE NOT failed HAVING count(*) > 0
    UNION ALL (SELECT 'most tokens', event_id::VARCHAR, tokens_count FROM s WHERE NOT failed ORDER BY tokens_count DESC, event_id LIMIT 5)
    UNION ALL SELECT 'failed', 'events/' || event_id, 1 FROM s WHERE failed
    UNION ALL SELECT 'total', 'tokens', coalesce(sum(tokens_count) FILTER (NOT failed), 0)::BIGINT FROM s
    UNION ALL SELECT 'report', 'events/' || event_id, len(keys) FROM s WHERE NOT failed AND len(keys) > 0
    UNION ALL SELECT 'stats', 'chars', coalesce(sum(chars_count) FILTER (NOT failed), 0)::BIGINT FROM s
""")
def batch_report(spark, sf_dir):
    """All that a batch over files gives: counts, the largest files, those with errors, totals, and its reports read back."""
    done = _batch(spark, sf_dir)
    rows = lambda part, df, name, n: df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    folder = shared_folder(spark, "batch-reports")
    done.write_reports(folder, "json", "events")
    report = reports.read_entity_report(spark, f"{folder}/entities").groupBy("file").agg(F.count("*").alias("n"))
    stats = spark.read.schema("chars_count long").json(f"{folder}/stats").agg(F.coalesce(F.sum("chars_count"), F.lit(0)).alias("n"))
    failed = spark.read.schema("doc_id long, path string, error struct<text:string>").json(f"{folder}/failed").filter("error.text is not null")
    parts = [
        rows("count", done.counts(), F.col("type"), F.col("n")), rows("most tokens", done.most("tokens_count"), F.col("doc_id"), F.col("tokens_count")), rows("failed", failed, F.col("path"), F.lit(1)),
        rows("total", done.totals_frame(), F.lit("tokens"), F.col("tokens_count")), rows("report", report, F.col("file"), F.col("n")), rows("stats", stats, F.lit("chars"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT p_brand AS type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand")
def count_by_type(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("value"))
    return entities.count_by_type(found)


# Grammar analysis: a grammar for each turn. Word k is terminal Tk; tk is Tk, or nothing where the word's length is even; rk is tk and the rest, lk is tk lk Tk or Tk.

_GRAMMAR_WORDS = f"""
    SELECT doc_id, nr, length(w) % 2 = 0 AS even, count(*) OVER (PARTITION BY doc_id) AS size,
        min(CASE WHEN length(w) % 2 = 1 THEN nr END) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS solid FROM ({_TURN_WORDS})
"""
#: What rk begins with: the terminals up to the first word of odd length; with ``nothing``, whether it may be empty.
_BEGINS = f"SELECT doc_id, nr, 'T' || unnest(range(nr, coalesce(solid, size) + 1)) AS symbol FROM ({_GRAMMAR_WORDS})"


def turn_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda k: (k + 1).cast("string")
    numbered = lambda *parts: lambda w, k: F.concat(*(number(k) if p is None else p(w, k) if callable(p) else F.lit(p) for p in parts))
    maybe = lambda w, k: F.when(F.length(w) % 2 == 0, " |").otherwise("")
    rest = lambda w, k: F.when(k + 1 < F.col("size"), F.concat(F.lit(" r"), (k + 2).cast("string"))).otherwise("")
    pieces = [
        numbered("T", None, " : 'w", None, "'\n"), numbered("t", None, " = T", None, maybe, "\n"), numbered("r", None, " = t", None, rest, "\n"),
        numbered("l", None, " = t", None, " l", None, " T", None, " | T", None, "\n"),
    ]
    text = F.concat(*(F.array_join(F.transform("words", p), "") for p in pieces), F.lit("%%\n%parsing start r1\n"))
    # words and their number are columns: within a piece, the text would be searched again for each word
    words = turns(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)).alias("words"))
    return words.select("doc_id", "words", F.size("words").alias("size")).filter("size > 0").select("doc_id", text.alias("text"))


def _sets(spark: SparkSession, sf_dir: str, kind: str, rules: str) -> DataFrame:
    found = grammars.analysis(turn_grammars(spark, sf_dir), [kind], only=lambda rule: rule.startswith(rules)).filter(F.substring("rule", 1, 1) == rules)
    return found.select("doc_id", F.expr("cast(substring(rule, 2) as int)").alias("nr"), "symbol", "n")


@query(f"SELECT doc_id, (size - nr + 1)::BIGINT AS n, nr::INT AS nr FROM ({_GRAMMAR_WORDS})")
def reachable_symbols(spark, sf_dir):
    """How many terminals are below each rule."""
    return _sets(spark, sf_dir, "reachable_count", "r").select("doc_id", "nr", F.col("n").cast("long").alias("n"))


@query(f"SELECT doc_id, nr::INT AS nr FROM ({_GRAMMAR_WORDS}) WHERE even")
def left_recursion(spark, sf_dir):
    """Rules that can begin with themselves, behind what may be empty."""
    return _sets(spark, sf_dir, "left_recursive", "l").select("doc_id", "nr")


_AFTER = f"""
    SELECT w.doc_id, w.nr, b.symbol FROM ({_GRAMMAR_WORDS}) w JOIN ({_BEGINS}) b ON w.doc_id = b.doc_id AND b.nr = w.nr + 1
    UNION ALL SELECT w.doc_id, w.nr, 'EOF' FROM ({_GRAMMAR_WORDS}) w LEFT JOIN ({_GRAMMAR_WORDS}) n ON w.doc_id = n.doc_id AND n.nr = w.nr + 1 WHERE n.solid IS NULL
    UNION ALL SELECT doc_id, nr, 'T' || nr FROM ({_GRAMMAR_WORDS})
"""


@query(f"""
    SELECT doc_id, nr::INT AS nr, symbol, count(*) AS n FROM (
        SELECT doc_id, nr, 'T' || nr AS symbol, 1 AS alternative FROM ({_GRAMMAR_WORDS}) UNION SELECT w.doc_id, w.nr, a.symbol, 2 FROM ({_GRAMMAR_WORDS}) w JOIN ({_AFTER}) a ON w.doc_id = a.doc_id AND w.nr = a.nr WHERE even) GROUP BY ALL
""")
def ll_table(spark, sf_dir):
    """How many alternatives each cell of the LL(1) table has, for rules that may be empty."""
    return _sets(spark, sf_dir, "ll_cell", "t").withColumn("n", F.col("n").cast("long"))


@query(f"SELECT doc_id, nr::INT AS nr, symbol FROM ({_BEGINS})")
def first_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "first", "r").select("doc_id", "nr", "symbol")


@query(f"SELECT DISTINCT doc_id, nr::INT AS nr, symbol FROM ({_AFTER})")
def follow_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "follow", "t").select("doc_id", "nr", "symbol")


# Text functions.


@query("""
    SELECT c_custkey, trim(substr(c_name, 10)) AS inner_name, replace(c_name, '#', ' ') AS collapsed, substr(c_name, 1, 3) || substr(c_name, 6) AS cut, (position('#' IN c_name) - 1)::INT AS hash_at, (length(s) - length(ltrim(s, '0')))::INT AS zeros
    FROM (SELECT *, substr(c_name, 10) AS s FROM customer)
""")
def text_functions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.col("c_name")
    return c.select(
        "c_custkey", enclosed_name(name, "Customer#").alias("inner_name"), collapse_breaks(F.replace(name, F.lit("#"), F.lit("\n\t"))).alias("collapsed"), cut_out(name, F.lit(3), F.lit(2)).alias("cut"),
        index_of(name, "#", F.lit(2)).alias("hash_at"), leading_count(F.expr("substr(c_name, 10)"), "0").alias("zeros"),
    )


@query("SELECT r_regionkey, array_to_string([CASE WHEN lower(x) <> upper(x) THEN '[' || lower(x) || upper(x) || ']' ELSE x END FOR x IN string_split(r_name, '')], '') AS pattern FROM region")
def either_case_patterns(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", either_case(F.col("r_name")).alias("pattern"))


# Second extractors and visitors.

_CODE = " UNION ALL ".join(f"SELECT p_partkey AS doc_id, '{t}' AS type, '{n}' || p_partkey AS value FROM part" for t, n in (("method", "m"), ("field", "f"), ("class", "C")))


def java_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each part, with a field and a method, and with what misleads plain patterns."""
    pieces = ["public class C", " {\n /* class X { */ int f", ' = 1; String m', '(int a) { call("}", a); }\n}\n']
    text = F.concat(*(x for p in pieces[:-1] for x in (F.lit(p), F.col("p_partkey").cast("string"))), F.lit(pieces[-1]))
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), small=True)


@query(_CODE)
def java_entities(spark, sf_dir):
    return frames.entities(java_code(spark, sf_dir), catalog.grammar("java"), ["class", "method", "field"]).select("doc_id", "type", "value")


@query(_CODE)
def java_baseline(spark, sf_dir):
    return baselines.baseline(java_code(spark, sf_dir), "java")


@query("SELECT p_partkey AS doc_id, 'method' AS type, 'x' || p_partkey AS value FROM part WHERE p_partkey % 2 = 0")
def java_disagreement(spark, sf_dir):
    """What only one of the two extractors finds: calls that plain patterns take for methods."""
    call = F.when(F.col("doc_id") >= 0, F.array_join(F.transform(F.filter(F.regexp_extract_all("text", F.lit(r"m(\d+)\("), F.lit(1)), lambda n: n.cast("int") % 2 == 0), lambda n: F.concat(F.lit("void g"), n, F.lit("() { assert x"), n, F.lit("(); }\n"))), ""))
    docs = java_code(spark, sf_dir).withColumn("text", F.concat(F.expr("substr(text, 1, length(text) - 2)"), call, F.lit("}\n")))
    parsed = frames.entities(docs, catalog.grammar("java"), ["class", "method", "field"]).select("doc_id", "type", "value")
    return compare.symmetric(parsed, baselines.baseline(docs, "java"))


@query(f"""
    SELECT doc_id, 'p_' || w AS name, (length(w) % 3 > 0)::INT::BIGINT AS n_blocks, (length(w) % 3 = 2)::INT::BIGINT AS n_routines FROM ({_TURN_WORDS})
    UNION ALL SELECT doc_id, 'q_' || w, 1, 0 FROM ({_TURN_WORDS}) WHERE length(w) % 3 = 2
""")
def routine_visitor(spark, sf_dir):
    """Routines that are announced, that have a block, or that have another routine and a block: each takes its own."""
    inner = lambda w: F.concat(F.lit("function q_"), w, F.lit(": integer; begin y := 1; end; begin z; end;\n"))
    rest = lambda w: F.when(F.length(w) % 3 == 0, "forward;\n").when(F.length(w) % 3 == 1, "begin x; end;\n").otherwise(inner(w))
    docs = turn_code(spark, sf_dir, lambda w: F.concat(F.lit("procedure p_"), w, F.lit("(a: integer); "), rest(w)))
    found = frames.entities_holding(docs, visitors.with_visitors(catalog.grammar("pascal"), visitors.aggregate_routines), ["routine"], ["block", "routine"])
    return found.select("doc_id", F.col("value").alias("name"), F.col("block").alias("n_blocks"), F.col("routine").alias("n_routines"))


def _supplier_code(spark: SparkSession, sf_dir: str, pieces: list[str]) -> DataFrame:
    """A piece of code for each supplier, with their number between the pieces."""
    text = F.concat(*(x for p in pieces[:-1] for x in (F.lit(p), F.col("s_suppkey").cast("string"))), F.lit(pieces[-1]))
    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))


def _members(spark: SparkSession, sf_dir: str, pieces: list[str], head: list[str], tail: str) -> DataFrame:
    """For each nation a text with a piece of code for each of its suppliers, with their number between its parts; ``head`` stands around the nation's number."""
    key = F.col("s_suppkey").cast("string")
    member = F.concat(*(x for p in pieces[:-1] for x in (F.lit(p), key)), F.lit(pieces[-1]))
    bodies = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct("s_suppkey", member.alias("m")).alias("m")).groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("m"))["m"], "").alias("body"))
    own = table(spark, sf_dir, "nation").join(bodies, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    text = F.concat(F.lit(head[0]), "n_nationkey", F.lit(head[1]), F.coalesce("body", F.lit("")), F.lit(tail))
    # few long texts, which would else all come to one task
    return own.select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text")).repartition(spark.sparkContext.defaultParallelism)


_SUPPLIED = "SELECT s_nationkey::BIGINT AS doc_id, '{0}' AS type, '{1}' || s_suppkey AS value FROM supplier"
_CSHARP = " UNION ALL ".join(["SELECT n_nationkey::BIGINT AS doc_id, 'class' AS type, 'C' || n_nationkey AS value FROM nation", *(_SUPPLIED.format(t, n) for t, n in (("field", "f"), ("property", "P"), ("method", "M"), ("struct", "S")))])
_CSHARP_OF_SUPPLIERS = " UNION ALL ".join(f"SELECT s_suppkey AS doc_id, '{t}' AS type, '{n}' || s_suppkey AS value FROM supplier" for t, n in (("class", "C"), ("field", "f"), ("property", "P"), ("method", "M"), ("struct", "S")))
_CSHARP_TYPES = ["class", "struct", "field", "property", "method"]


def csharp_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = ["\n/* class X { */ private readonly int f", ' = 1; // struct Y { }\n public string P', ' { get; set; }\n internal string M', '(int a) { call("}", a); }\n struct S', " { }"]
    return _members(spark, sf_dir, pieces, ["namespace N.M { public sealed class C", " : Base {"], "\n} }")


@query(_CSHARP)
def csharp_entities(spark, sf_dir):
    return frames.entities(csharp_code(spark, sf_dir), catalog.grammar("csharp"), _CSHARP_TYPES).select("doc_id", "type", "value")


@query(_CSHARP)
def csharp_lr_entities(spark, sf_dir):
    return frames.entities(csharp_code(spark, sf_dir), catalog.grammar("csharp_lr"), _CSHARP_TYPES).select("doc_id", "type", "value")


@query(_CSHARP)
def csharp_baseline(spark, sf_dir):
    return baselines.baseline(csharp_code(spark, sf_dir), "csharp")


_PASCAL = " UNION ALL ".join([_SUPPLIED.format("class", "T"), _SUPPLIED.format("routine", "R"), _SUPPLIED.format("routine", "Q"), _SUPPLIED.format("property", "P")])


def pascal_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = ["\n{ type X = class }\ntype T", " = class(TBase)\n private f: integer; // procedure no;\n public procedure R", "(a: integer); virtual;\n property P", ": integer read f;\n end;\nfunction Q", ": string; begin case x of 1: begin y('end'); end; end; end;\n"]
    return _members(spark, sf_dir, pieces, ["unit U", "; interface uses A;"], "\nend.")


@query(_PASCAL)
def pascal_entities(spark, sf_dir):
    return frames.entities(pascal_code(spark, sf_dir), catalog.grammar("pascal"), ["class", "routine", "property"]).select("doc_id", "type", "value")


@query(_PASCAL)
def pascal_baseline(spark, sf_dir):
    return baselines.baseline(pascal_code(spark, sf_dir), "pascal")


@query(f"""
    SELECT doc_id, '***' || chr(10) || 'nation/' || doc_id || coalesce(string_agg(chr(10) || type || chr(10) || value, '' ORDER BY k), '') AS line FROM (
        SELECT n_nationkey::BIGINT AS doc_id, type, value, k FROM nation LEFT JOIN (SELECT s_nationkey, 'property' AS type, 'P' || s_suppkey AS value, s_suppkey AS k FROM supplier) ON n_nationkey = s_nationkey) GROUP BY doc_id
""")
def entity_report(spark, sf_dir):
    """The report of a grammar's entities, a block for each file."""
    docs = pascal_code(spark, sf_dir)
    found = frames.entities(docs, catalog.grammar("pascal"), ["property"])
    return reports.entity_report(found, docs.select("doc_id", F.concat(F.lit("nation/"), "doc_id").alias("path")))


@query(f"""
    WITH f AS ({_CSHARP_OF_SUPPLIERS}) SELECT 'supplier/' || doc_id AS file, type, value FROM f
""")
def entity_report_read(spark, sf_dir):
    """A report written for all files and read back."""
    pieces = ["namespace N.M { public sealed class C", " : Base {\n/* class X { */ private readonly int f", ' = 1; // struct Y { }\n public string P', ' { get; set; }\n internal string M', '(int a) { call("}", a); }\n struct S', " { }\n} }"]
    docs, path = _supplier_code(spark, sf_dir, pieces), shared_folder(spark, "entities")
    found = frames.entities(docs, catalog.grammar("csharp"), _CSHARP_TYPES)
    reports.write_entity_report(found, docs.select("doc_id", F.concat(F.lit("supplier/"), "doc_id").alias("path")), path, "csharp", "supplier")
    return reports.read_entity_report(spark, path).select("file", "type", "value")


@query(_CSHARP)
def by_type_read(spark, sf_dir):
    """Entities in a folder for each type, read back."""
    path = shared_folder(spark, "types")
    reports.write_by_type(frames.entities(csharp_code(spark, sf_dir), catalog.grammar("csharp"), _CSHARP_TYPES), path)
    return spark.read.parquet(path).select("doc_id", F.col("type").cast("string").alias("type"), "value")


@query(f"SELECT doc_id, n_words::BIGINT AS tokens_count FROM (SELECT conv_id * 16777216 + turn AS doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS n_words FROM conversations)")
def stats_read(spark, sf_dir):
    """Statistics written as JSON twice, and read back once."""
    path, stats = shared_folder(spark, "stats"), frames.stats(turns(spark, sf_dir), catalog.grammar("words"))
    for _ in range(2):
        reports.write_stats(stats, path)
    return spark.read.schema("doc_id long, tokens_count long").json(path)


@query(f"SELECT 'left' AS side, value::INT AS value FROM (({_BAGS[0]}) EXCEPT ALL ({_BAGS[1]})) UNION ALL SELECT 'right', value::INT FROM (({_BAGS[1]}) EXCEPT ALL ({_BAGS[0]}))")
def differences_read(spark, sf_dir):
    """What only one of two bags holds, written and read back."""
    path = shared_folder(spark, "differences")
    reports.write_differences(*compare.difference(*bags(spark, sf_dir)), path)
    side = lambda name: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("side"), F.col("value").cast("int").alias("value"))
    return side("left").unionByName(side("right"))


@query(f"SELECT doc_id, type, value FROM ({_CSHARP}) WHERE type IN ('class', 'method')")
def table_functions(spark, sf_dir):
    """A grammar's entities by a table function in SQL."""
    frames.register_functions(spark, "csharp", catalog.grammar("csharp"), ["class", "method"])
    return spark.sql("SELECT d.doc_id, t.type, t.value FROM {code} d, LATERAL csharp_entities(d.text) t", code=csharp_code(spark, sf_dir))


_WORDS_OF_TURNS = "SELECT conv_id * 16777216 + turn AS doc_id, unnest(regexp_extract_all(text, '{0}')) AS value FROM conversations"


@query(f"""
    WITH a AS ({_WORDS_OF_TURNS.format("[A-Za-z]+")}), b AS ({_WORDS_OF_TURNS.format("[A-Za-zÀ-ÖØ-öø-ÿ]+")})
    SELECT 'left' AS side, 'turn/' || doc_id AS file, value FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', 'turn/' || doc_id, value FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def reports_compared(spark, sf_dir):
    """Reports of two extractors written, paired by their names, read, and compared into files: a plain pattern's words against a grammar's tokens."""
    folder, docs = shared_folder(spark, "compared"), turns(spark, sf_dir)
    file = F.concat(F.lit("turn/"), "doc_id").alias("file")
    plain = docs.select(file, F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("seq", "value"))
    tokens = frames.tokens(docs, catalog.grammar("words")).select(file, F.col("tok_idx").alias("seq"), F.col("text").alias("value"))
    both = plain.withColumn("type", F.lit("word_baseline")).unionByName(tokens.withColumn("type", F.lit("word_tolerant")))
    reports.write_value_report(both, f"{folder}/reports")
    paths = spark.createDataFrame([(p,) for p in reports.report_folders(spark, f"{folder}/reports")], "path string")
    pair = compare.report_pairs(paths).first()
    reports.compare_reports(spark, pair.first, pair.second, f"{folder}/out")
    side = lambda name: spark.read.parquet(f"{folder}/out/{name}").select(F.lit(name).alias("side"), "file", "value")
    return side("left").unionByName(side("right"))


# The other bundled extractors, over a piece of code for each supplier; how often a part comes depends on the supplier's number.


def _counted(spark: SparkSession, sf_dir: str, grammar: str, text, types: list[str]) -> DataFrame:
    """(doc_id, type, n) of what a bundled grammar finds in ``text`` (a column over suppliers); documents with errors would have nothing."""
    docs = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))
    return frames.entities(docs, catalog.grammar(grammar), types).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def _times(text: str, modulus: int, more: int = 0):
    return F.repeat(F.lit(text), (F.col("s_suppkey") % modulus + more).cast("int"))


def _counts(**numbers: str) -> str:
    """SQL for (doc_id, type, n) of suppliers, without types that do not occur; k is the supplier's number."""
    parts = (f"SELECT k AS doc_id, '{t.rstrip('_')}' AS type, ({n})::BIGINT AS n FROM (SELECT s_suppkey AS k FROM supplier)" for t, n in numbers.items())
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query(_counts(if_="k % 3 + 1", else_="k % 3 + 1", switch="k % 2", label="2 * (k % 2)"))
def csharp_branch_counts(spark, sf_dir):
    text = F.concat(_times("a(); if (x) { b(); } else { c(); }\n", 3, 1), _times("switch (y) { case 1: c(); break; default: d(); }\n", 2))
    return _counted(spark, sf_dir, "csharp_branches", text, ["if", "else", "switch", "label"])


@query(_counts(if_="k % 3 + 1", switch="k % 2", section="2 * (k % 2)"))
def csharp_whole_branch_counts(spark, sf_dir):
    text = F.concat(_times("a(); if (x) { b(); } else { c(); }\n", 3, 1), _times("switch (y) { case 1: c(); break; default: d(); }\n", 2))
    return _counted(spark, sf_dir, "csharp_branches_whole", text, ["if", "switch", "section"])


@query(_counts(loop="k % 4 + 1", do="1", if_="k % 4", else_="k % 4"))
def csharp_operator_counts(spark, sf_dir):
    text = F.concat(_times("for (;;) { if (x) { a(); } else { b(); } }\n", 4), F.lit("do { } while (x);"))
    return _counted(spark, sf_dir, "csharp_operators_lr", text, ["loop", "do", "if", "else"])


@query(_counts(scope="1", type="k % 5 + 1", enum="k % 2"))
def csharp_member_counts(spark, sf_dir):
    text = F.concat(F.lit("namespace N { /* class X { */ struct S { }\n"), _times("class C : B { int f = 1; void M() { } }\n", 5), _times("enum E { A }\n", 2), F.lit("}"))
    return _counted(spark, sf_dir, "csharp_members", text, ["scope", "type", "enum"])


@query(_counts(namespace="1", class_="k % 5"))
def csharp_type_counts(spark, sf_dir):
    text = F.concat(F.lit("namespace N { /* class X { */\n"), _times("class C : B { int f = 1; void M() { } }\n", 5), F.lit("}"))
    return _counted(spark, sf_dir, "csharp_types", text, ["namespace", "class"])


@query(_CODE)
def java_lr_entities(spark, sf_dir):
    return frames.entities(java_code(spark, sf_dir), catalog.grammar("java_lr"), ["class", "method", "field"]).select("doc_id", "type", "value")


@query(_counts(class_="1", field="k % 3 + 1", method="k % 2"))
def java_plain_counts(spark, sf_dir):
    text = F.concat(F.lit("class C { // int no;\n"), _times("int f;\n", 3, 1), _times("void m(int a) { { x } y }\n", 2), F.lit("}"))
    return _counted(spark, sf_dir, "java_plain_lr", text, ["class", "field", "method"])


@query(_counts(routine="1 + k % 2", if_="k % 3", loop="k % 4"))
def pascal_statement_counts(spark, sf_dir):
    inner = F.concat(_times("if x > 1 then begin y := 2 end else z := 3;\n", 3), _times("for i := 1 to 5 do begin Q(i); end;\n", 4))
    text = F.concat(F.lit("program P; procedure Q(x: real); begin y := 1; end;\n"), _times("function F: real; begin y := 1; end;\n", 2), F.lit("begin\n"), inner, F.lit("end."))
    return _counted(spark, sf_dir, "pascal_statements", text, ["routine", "if", "loop"])


@query(_counts(routine="k % 4 + 1"))
def pascal_routine_counts(spark, sf_dir):
    text = F.concat(F.lit("program P; function R: integer; begin z end; // procedure no;\n"), _times("procedure Q(x: real); begin case y of end; end;\n", 4), F.lit("begin end."))
    return _counted(spark, sf_dir, "pascal_routines", text, ["routine"])


@query(_counts(element="k % 7 + 1"))
def xml_counts(spark, sf_dir):
    text = F.concat(F.lit("<?xml version='1.0'?><a><!-- <x> -->"), _times("<b c='<'>it's", 7), _times("</b>", 7), F.lit("</a>"))
    return _counted(spark, sf_dir, "xml", text, ["element"])


@query(_counts(class_="1", field="k % 3", method="k % 2", function="1", enum="k % 2"))
def typescript_counts(spark, sf_dir):
    text = F.concat(F.lit("export class A<T extends B<C>> {\n"), _times("x: number = 1;\n", 3), _times("get<K>(a: b): c { }\n", 2), F.lit("}\nfunction g(x) { y }\n"), _times("enum E { A }\n", 2))
    return _counted(spark, sf_dir, "typescript", text, ["class", "field", "method", "function", "enum"])


@query(_counts(rule="k % 5 + 1", symbols="2"))
def yacc_counts(spark, sf_dir):
    text = F.concat(F.lit("%token <n> A B\n%left '+'\n%%\n"), _times("e : e[x] '+' t { x { y } } | t %prec B ;\n", 5), F.lit("t : A ;\n%%\nrest"))
    return _counted(spark, sf_dir, "yacc", text, ["rule", "symbols"])


@query(_counts(states="1", definition="k % 3", rule="k % 4 + 1", group="1"))
def lex_counts(spark, sf_dir):
    text = F.concat(F.lit("%x ST\n"), _times("D   [0-9]\n", 3), F.lit("%%\n"), _times("[a-z]+ { a }\n", 4), F.lit("<ST>abc { b }\n%%\nrest"))
    return _counted(spark, sf_dir, "lex", text, ["states", "definition", "rule", "group"])


@query(_counts(call="k % 5", block="1"))
def brace_counts(spark, sf_dir):
    return _counted(spark, sf_dir, "braces_lr", F.concat(_times("call(a b);\n", 5), F.lit("{ b { c } }")), ["call", "block"])


@query(_counts(entry="k % 6 + 1", cause="k % 3 + k % 6"))
def log_counts(spark, sf_dir):
    """Water after water: entries of a log, with what caused them."""
    text = F.concat(_times("7:2 info up and down caused by\n", 6), F.lit("8:3 last "), _times("caused by ", 3))
    return _counted(spark, sf_dir, "consecutive_water", text, ["entry", "cause"])


# Preprocessors in a row, grammar messages, spans, rendering.

_CHAIN = "'{$define A}{ note }' || repeat('{$undef A}', (s_suppkey % 2)::INT) || '{$ifdef A}procedure p; begin x; end;{$else}function q: real; begin y; end;{$endif} begin end.'"


@query(f"""
    SELECT s_suppkey AS doc_id, (position(w IN t) - 1)::INT AS start_off FROM (SELECT s_suppkey, {_CHAIN} AS t, CASE s_suppkey % 2 WHEN 0 THEN 'procedure' ELSE 'function' END AS w FROM supplier)
""")
def pascal_chain(spark, sf_dir):
    """Pascal's directives, then its routines with their blocks, by a pipeline of registered preprocessors; places in the whole texts."""
    docs = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.expr(_CHAIN.replace("::INT", "").replace("(s_suppkey % 2)", "cast(s_suppkey % 2 as int)")).alias("text")))
    chain = preprocess.pipeline(preprocess.REGISTRY["noop"](), preprocess.REGISTRY["conditional"](catalog.grammar("pascal_directives")))
    nodes = preprocess.nodes_through(docs, visitors.with_visitors(catalog.grammar("pascal"), visitors.aggregate_routines), chain)
    return nodes.filter("type = 'routine'").select("doc_id", "start_off")


@query(f"SELECT doc_id, 'error' AS kind, count(*) AS n FROM ({_GRAMMAR_WORDS}) WHERE even GROUP BY doc_id")
def grammar_messages(spark, sf_dir):
    """What the checks say of each turn's grammar: every rule that can begin with itself."""
    found = grammars.analysis(turn_grammars(spark, sf_dir), ["message"])
    return found.groupBy("doc_id", F.col("rule").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, min(s) AS start_off, max(e) AS end_off FROM ({_LEAVES}) GROUP BY doc_id")
def node_hulls(spark, sf_dir):
    """The place of a document's root from those of its sentences alone."""
    nodes = _leaves_and_blocks(spark, sf_dir)[0].withColumns({c: F.when(F.col("node_id") > 0, F.col(c)) for c in ("start_off", "end_off")})
    return trees.spans(nodes).filter("node_id = 0").select("doc_id", "start_off", "end_off")


@query(f"SELECT 'chars_count: ' || sum(chars_count) || '; tokens_count: ' || sum(tokens_count) || '; recovery_times: 0; longest_rollback: 0; recovery_times_any: 0' AS line FROM ({_STATS})")
def stats_rendered(spark, sf_dir):
    return entities.render_stats(entities.fold_stats(frames.stats(documents(spark, sf_dir), catalog.grammar("words"))))


#: Options of a place in a rule hide all global ones: a pair's first word is a leaf there, its second one is dropped as everywhere.
_PLACES_OF_WORDS = "WORD : [A-Za-z]+\n\ntext = pair*\npair = %nodes(leaf) word '-' word\nword = WORD letters\nletters = '!'?\n\n%%\n%parsing start text\n%nodes void word"


@query(f"SELECT doc_id, w AS first, 1::BIGINT AS n FROM ({_TURN_WORDS})")
def local_options(spark, sf_dir):
    """Nodes whose options depend on where they stand."""
    docs = turn_code(spark, sf_dir, lambda w: F.concat(w, F.lit("! - "), F.lit("x ")))
    nodes = frames.nodes(docs, compile_grammar(_PLACES_OF_WORDS, "LL"), columns=["doc_id", "node_id", "value"], only=lambda n: n.symbol == "word")
    return nodes.groupBy("doc_id", "node_id").agg(F.regexp_replace(F.array_join(F.first("value"), ""), "!", "").alias("first"), F.count("*").alias("n")).drop("node_id")
