"""More queries: matching, components, cycles, numbers and concepts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import facts, query, table, trigger_rows
from .operators import components, concepts, decisions, entities, flow, integrity, matching, ordering, planning, rules, strong
from .plans import cached, mapping
from .providers import Stub, WordStub
from .session import checkpoint_dir
from .streaming import fanout

_KEYED = """n AS (SELECT DISTINCT starts_with(url, 'https:') AS a, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-zà-ÿ]+', ' ', 'g')) AS name FROM pages),
r AS (SELECT a, name, contains(name, ' ') AS words FROM n WHERE name <> '' AND name NOT IN (SELECT name FROM n GROUP BY name HAVING count(*) = 2)),
g AS (SELECT *, list_distinct(string_split(name, ' ')) AS w, list_distinct(list_transform(range(1, greatest(length(replace(name, ' ', '')) - 2, 1) + 1), lambda i: substr(replace(name, ' ', ''), i, 3))) AS t FROM r),
c AS (SELECT x.name AS x, y.name AS y, CASE WHEN x.words AND y.words THEN 2.0::DOUBLE * len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w)) ELSE 2.0::DOUBLE * len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t)) END AS score
  FROM g x JOIN g y ON x.a AND NOT y.a),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, x, y) AS k FROM c WHERE score >= 0.8),
s(k, xs, ys) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL
  SELECT o.k, CASE WHEN list_contains(s.xs, o.x) OR list_contains(s.ys, o.y) THEN s.xs ELSE list_append(s.xs, o.x) END, CASE WHEN list_contains(s.xs, o.x) OR list_contains(s.ys, o.y) THEN s.ys ELSE list_append(s.ys, o.y) END FROM s JOIN o ON o.k = s.k + 1),
z AS (SELECT xs, ys FROM s ORDER BY k DESC LIMIT 1),
m AS (SELECT unnest(xs) AS name_a, unnest(ys) AS name_b FROM z),
t AS (SELECT name AS name_a, name AS name_b, 1.0::DOUBLE AS score FROM n WHERE name <> '' GROUP BY name HAVING count(*) = 2
  UNION ALL SELECT m.name_a, m.name_b, o.score FROM m JOIN o ON o.x = m.name_a AND o.y = m.name_b
  UNION ALL SELECT name, NULL, NULL FROM r WHERE a AND name NOT IN (SELECT name_a FROM m)
  UNION ALL SELECT NULL, name, NULL FROM r WHERE NOT a AND name NOT IN (SELECT name_b FROM m))"""


def _title_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of pages by their scheme: the two legs of a stability run."""
    p = table(spark, sf, "pages").select(F.col("url").startswith("https:").alias("a"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    return matching.match_names(p.filter("a"), p.filter("not a"), key=lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-zà-ÿ]+", " ")))


@query(f"WITH RECURSIVE {_KEYED} SELECT * FROM t")
def fuzzy_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of one leg, each with its one partner in the other."""
    return _title_matches(spark, sf)


@query(f"""WITH RECURSIVE {_KEYED}, q AS (SELECT count(*) FILTER (WHERE name_a = name_b) AS exact, count(*) FILTER (WHERE name_a <> name_b) AS fuzzy, count(*) FILTER (WHERE name_a IS NULL OR name_b IS NULL) AS alone FROM t)
SELECT *, (exact + fuzzy)::DOUBLE / (exact + fuzzy + alone) AS fuzzy_jaccard FROM q""")
def fuzzy_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return matching.fuzzy_agreement(_title_matches(spark, sf))


def _part_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Two kinds of edges between parts: by number and size, and downwards for small sizes."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("s"))
    n = p.agg(F.count(F.lit(1)).alias("_n"))  # one row
    one = p.join(F.broadcast(n), how="cross").select(F.col("p").alias("source"), ((F.col("p") * F.col("s") + 7) % F.col("_n")).alias("target"), F.col("s"))
    two = p.filter("s <= 10").select(F.col("p").alias("source"), F.floor(F.col("p") / 2).alias("target"), "s")
    return one.unionByName(two)


_STEPS = "e AS (SELECT DISTINCT p_partkey AS a, (p_partkey * p_size + 7) % (SELECT count(*) FROM part) AS b FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size <= 10)"


@query(f"""WITH RECURSIVE {_STEPS}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
SELECT e.a AS source, e.b AS target, CASE WHEN e.a = e.b THEN coalesce(m.root, e.a) ELSE m.root END AS root FROM e LEFT JOIN m ON m.node = e.a LEFT JOIN m o ON o.node = e.b
WHERE e.a = e.b OR m.root = o.root""")
def edges_on_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Which edges lie on a cycle, by strongly connected component."""
    return strong.cycle_edges(_part_steps(spark, sf).select("source", "target"))


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS a, (p_partkey * p_size + 7) % (SELECT count(*) FROM part) AS b FROM part),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT a, a FROM l),
r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT node, min(seen) AS root FROM r GROUP BY node""")
def growing_components(spark: SparkSession, sf: str) -> DataFrame:
    """Parts linked by number and size, the links coming in three batches."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("a"), F.col("p_size").cast("long").alias("s"))
    n = p.agg(F.count(F.lit(1)).alias("_n"))  # one row
    links = p.join(F.broadcast(n), how="cross").select("a", ((F.col("a") * F.col("s") + 7) % F.col("_n")).alias("b"))
    roots = spark.createDataFrame([], "node long, root long")
    for k in range(3):
        change = components.cut(components.extend_components(roots, links.filter(F.col("a") % 3 == k)))
        roots = components.cut(entities.replace_by_key(roots, change, "node"))
    return roots


@query("""WITH RECURSIVE d AS (SELECT doc_id AS pos, regexp_extract_all(lower(text), '[a-z]+') AS w, source FROM documents),
c AS (SELECT pos, CASE WHEN len(w) > 0 THEN w[1] END AS name, w[2] AS th, CASE WHEN len(w) > 3 THEN w[3] || w[4] END AS id FROM d),
t AS (SELECT pos, 0 AS rank, 'key' AS kind, name AS token FROM c WHERE name IS NOT NULL UNION ALL SELECT pos, 1, 'key', th FROM c WHERE name IS NOT NULL AND th IS NOT NULL UNION ALL SELECT pos, 2, 'id', id FROM c WHERE name IS NOT NULL AND id IS NOT NULL),
f AS (SELECT kind, token, min(pos) AS first FROM t GROUP BY ALL),
o AS (SELECT t.pos, arg_min(first, rank) AS up FROM t JOIN f USING (kind, token) WHERE first < t.pos GROUP BY t.pos),
p AS (SELECT c.pos, o.up FROM c LEFT JOIN o USING (pos) WHERE name IS NOT NULL),
r AS (SELECT pos, pos AS root FROM p WHERE up IS NULL UNION ALL SELECT p.pos, r.root FROM p JOIN r ON p.up = r.pos),
k AS (SELECT root, row_number() OVER (ORDER BY root) AS canonical FROM (SELECT DISTINCT root FROM r))
SELECT c.pos AS doc_id, k.canonical FROM c LEFT JOIN r USING (pos) LEFT JOIN k USING (root)""")
def concept_consolidation(spark: SparkSession, sf: str) -> DataFrame:
    """First words of documents as concepts (name, other name, raw id), taken in two batches."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), w.alias("w"))
    c = d.select("pos", F.get("w", F.lit(0)).alias("name"), F.get("w", F.lit(1)).alias("name_th"), F.when(F.size("w") > 3, F.concat(F.get("w", F.lit(2)), F.get("w", F.lit(3)))).alias("raw_id"))
    half = c.agg((F.max("pos") / 2).alias("half")).first()[0] or 0
    tokens, nodes = concepts.empty_store(spark)
    out = []
    for part in (c.filter(F.col("pos") <= half), c.filter(F.col("pos") > half)):
        assigned, tokens, nodes = concepts.consolidate_concepts(part, tokens, nodes, key=lambda x: x)
        out.append(assigned)
    return out[0].unionByName(out[1]).select(F.col("pos").alias("doc_id"), "canonical")


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events")
def global_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's place by value, from ranges and counts."""
    return ordering.numbered(table(spark, sf, "events").select("event_id", "value"), F.desc("value"), "event_id", name="place").select("event_id", "place")


@query("""WITH e AS (SELECT user_id AS run, event_id AS seq, event_type = 'error' AS limited, value AS wait, CAST(round(value * 100) AS BIGINT) AS cost FROM events),
p AS (SELECT *, coalesce(sum(CAST(limited AS BIGINT)) OVER w, 0) AS waits, coalesce(sum(cost) OVER w, 0) AS spent FROM e WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CASE WHEN spent > 60000 THEN 'budget' WHEN limited AND (wait > 40 OR waits >= 1) THEN 'rate_limit' END AS why FROM p),
s AS (SELECT run, min(seq) AS at, arg_min(why, seq) AS why, arg_min(spent, seq) AS spent FROM y WHERE why IS NOT NULL GROUP BY run)
SELECT y.run, y.seq, CASE WHEN y.seq >= s.at THEN 'deferred' WHEN limited THEN 'waited' ELSE 'proceed' END AS decision, CASE WHEN y.seq >= s.at THEN s.why END AS reason, CAST(CASE WHEN y.seq >= s.at THEN s.spent ELSE y.spent END AS BIGINT) AS spent FROM y LEFT JOIN s USING (run)""")
def call_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as calls of a run: errors are rate limits, values waits and costs."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("limited"), F.col("value").alias("wait"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return flow.call_decisions(e, cap=40, budget=60_000).select("run", "seq", "decision", "reason", "spent")


@query("""SELECT f.event_id, v.event_id AS version, v.value AS version_value FROM (SELECT * FROM events WHERE event_type <> 'error') f
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') v ON f.user_id = v.user_id AND f.ts >= v.ts""")
def newest_version(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its user's newest error at or before it, as a turn meets the map of its time."""
    e = table(spark, sf, "events")
    versions = e.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("version"), F.col("value").alias("version_value"))
    return flow.as_of(e.filter("event_type <> 'error'").select("event_id", "user_id", "ts"), versions, "user_id", "ts", ["version", "version_value"]).select("event_id", "version", "version_value")


#: seed rows of the teaching policy: id, intent, special_handling, precedence, direct, full, attempt, hint_first, allow_hints, allow_check, prohibited, veto_primary
TEACHING = [
    ("B01", None, None, 0, True, True, None, False, True, True, [], None), ("B02", None, "pressure", 90, False, False, True, True, True, True, ["S05"], "S04"),
    ("B03", "solve", None, 50, False, True, False, True, True, False, [], "S06"), ("B04", "review", "none", 40, True, True, None, False, False, True, ["S00", "S01"], None),
]
TOGETHER = decisions.Combination(["S03", "S04"], ["S05", "S06"], ["S07"], {"S00": ["S01", "S02"], "S01": ["S02", "S04", "S07"], "S03": ["S01", "S02", "S07"], "S04": ["S02", "S03", "S07"], "S06": ["S01", "S02"], "S07": ["S01", "S02", "S04"]})


def decided(spark: SparkSession, turns: DataFrame) -> DataFrame:
    chosen = rules.select_trigger(turns, trigger_rows(spark), ("T99", "S00"))
    policies = spark.createDataFrame([(*p[:4], k, *p[4:]) for k, p in enumerate(TEACHING)], "id string, intent string, special_handling string, precedence int, seq int, direct boolean, full boolean, attempt boolean, hint_first boolean, allow_hints boolean, allow_check boolean, prohibited array<string>, veto_primary string")
    return decisions.decide(chosen, policies, TOGETHER)


@query()
def turn_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn through all steps, with its trace."""
    verdict = F.when(F.col("turn_id") % 4 == 0, F.lit("correct")).when(F.col("turn_id") % 4 == 1, F.lit("cannot_evaluate"))
    d = decided(spark, facts(spark, sf).withColumn("evaluation", verdict))
    said = F.transform("trace", lambda e: F.concat_ws(" ", e["step"], e["rule"], F.coalesce(e["source"], F.lit("-")), F.coalesce(e["gone"], F.lit("-")), F.coalesce(e["come"], F.lit("-"))))
    return d.select("turn_id", F.col("primary").alias("primary_strategy"), "supporting", "evaluation", "direct", "full", "attempt", "prohibited", "policy", said.alias("trace"))


@query("""WITH l AS (SELECT user_id AS subscriber, event_id AS seq, event_type = 'error' AS reads FROM events),
p AS (SELECT *, coalesce(sum(CAST(reads AS BIGINT)) OVER w, 0) AS segment FROM l WINDOW w AS (PARTITION BY subscriber ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, row_number() OVER (PARTITION BY subscriber, segment ORDER BY seq DESC) AS back FROM p WHERE NOT reads),
g AS (SELECT subscriber, segment, list(seq ORDER BY seq) FILTER (WHERE back <= 4) AS delivered, count(*) AS n FROM b GROUP BY ALL)
SELECT p.subscriber, p.seq AS read_seq, coalesce(g.delivered, []::BIGINT[]) AS delivered, CAST(greatest(coalesce(g.n, 0) - 4, 0) AS BIGINT) AS dropped FROM p LEFT JOIN g USING (subscriber, segment) WHERE reads""")
def queue_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Users as subscribers with queues of four: errors read, all else is published."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("subscriber"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("reads"))
    return fanout.deliveries(log, 4)


@query()
def cached_results(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's reply by the stub, from two runs over one result table, the second with new texts only to ask for."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select("doc_id", "text")
    cached.cached_stage(d.filter(F.length("text") % 2 == 0), path, "atomize", Stub(), "text", "doc_id", ("digest",))
    return cached.cached_stage(d, path, "atomize", Stub(), "text", "doc_id", ("digest",))[0].select("doc_id", F.get_json_object("result", "$.digest").alias("digest"), "from_version")


@query("""WITH t AS (SELECT conv_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{6,}') AS ws, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS u FROM conversations),
w AS (SELECT conv_id, u, i, ws[i] AS word FROM t, unnest(range(1, len(ws) + 1)) AS r(i)),
k AS (SELECT conv_id, lower(word) AS k, arg_min(word, u * 10000000 + i) AS name, min(u * 10000000 + i) AS first FROM w GROUP BY ALL),
n AS (SELECT *, printf('C%03d', row_number() OVER (PARTITION BY conv_id ORDER BY first)) AS label FROM k)
SELECT conv_id, label, name, NULL AS target FROM n
UNION ALL SELECT DISTINCT a.conv_id, x.label, x.name, y.label FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.u = b.u AND b.i = a.i + 1
JOIN n x ON x.conv_id = a.conv_id AND x.k = lower(a.word) JOIN n y ON y.conv_id = b.conv_id AND y.k = lower(b.word) WHERE x.label <> y.label""")
def proposed_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's map by the stub, concepts in batches of turns with a roster, then edges."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("course"), place.alias("ordinal"), F.col("turn").alias("chunk_id"), "text")
    made = mapping.propose_map(turns, WordStub(), path, ("leads_to",))
    nodes = made.nodes.select("course", "label", "name", F.lit(None).cast("string").alias("target"))
    edges = made.edges.select("course", F.col("source").alias("label"), "target").join(made.nodes.select("course", "label", "name"), ["course", "label"])
    return nodes.unionByName(edges).select(F.col("course").cast("long").alias("conv_id"), "label", "name", "target")


#: Rule tables of the planned turns.
PLANNING = planning.Planning(
    templates={
        "S01": planning.Template(("hook", "explanation", "check_question"), 120, False),
        "S02": planning.Template(("hint", "check_question"), 60, True),
        "S03": planning.Template(("explanation", "worked_solution", "recap"), 200),
        "S04": planning.Template(("quiz_question", "quiz_answer_key"), 80, True),
        "S05": planning.Template(("worked_solution",), 90, False),
        "S06": planning.Template(("feedback", "steps", "next_question", "check_question"), 100),
    },
    supporting={"S01": ("explanation", False), "S02": ("hint", False), "S03": ("worked_solution", False), "S04": ("quiz_question", False), "S05": ("recap", False), "S06": ("feedback", True)},
    blocks={
        "hook": (), "explanation": (), "check_question": ("question",), "hint": ("hint",), "worked_solution": ("solution",), "recap": (),
        "quiz_question": ("question",), "quiz_answer_key": ("solution", "answer_key"), "feedback": (), "steps": ("steps",), "next_question": ("question",),
    },
    wording={"beginner": "plain words", "advanced": "terms"},
)


@query("""WITH tpl(s, blocks, max_words, wait) AS (VALUES ('S01', ['hook', 'explanation', 'check_question'], 120, false), ('S02', ['hint', 'check_question'], 60, true),
 ('S03', ['explanation', 'worked_solution', 'recap'], 200, NULL), ('S04', ['quiz_question', 'quiz_answer_key'], 80, true), ('S05', ['worked_solution'], 90, false),
 ('S06', ['feedback', 'steps', 'next_question', 'check_question'], 100, NULL)),
sup(s, block, replies) AS (VALUES ('S01', 'explanation', false), ('S02', 'hint', false), ('S03', 'worked_solution', false), ('S04', 'quiz_question', false), ('S05', 'recap', false), ('S06', 'feedback', true)),
t AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, turn % 2 = 0 AS attempt, 'S0' || (n % 7 + 1) AS first, ['S0' || (n % 5 + 1), 'S0' || (n % 8 + 1), 'S0' || (turn % 6 + 1)] AS others, n % 3 <> 0 AS full_ok, n % 5 <> 0 AS direct_ok FROM conversations),
k AS (SELECT row_number() OVER () AS id, t.*, tpl.*, coalesce(wait, attempt) AS waits FROM t LEFT JOIN tpl ON first = s),
o AS (SELECT id, unnest(others) AS strategy, generate_subscripts(others, 1) AS pos FROM k WHERE blocks IS NOT NULL),
x AS (SELECT o.id, o.pos, o.strategy, sup.block, sup.s IS NULL AS unknown, waits AND replies AS later, list_contains(blocks, sup.block) AS inside FROM o JOIN k USING (id) LEFT JOIN sup ON o.strategy = sup.s),
a AS (SELECT id, block, 100 + min(pos) AS pos FROM x WHERE NOT unknown AND NOT inside AND NOT later GROUP BY ALL),
b AS (SELECT id, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS pos FROM k UNION ALL SELECT id, block, pos FROM a),
f AS (SELECT b.*, block IN ('worked_solution', 'quiz_answer_key') AS solution, block LIKE '%question' AS question, full_ok, direct_ok, bool_or(block = 'hint') OVER (PARTITION BY id) AS hinted FROM b JOIN k USING (id)),
g AS (SELECT *, CASE WHEN solution AND NOT full_ok THEN 'full_solution_withheld' WHEN solution AND NOT direct_ok THEN 'direct_answer_prohibited' WHEN block = 'quiz_answer_key' THEN 'quiz_answer_withheld'
 WHEN hinted AND (solution OR block = 'steps') THEN 'hint_first_and_full_solution_same_turn' WHEN question AND row_number() OVER (PARTITION BY id, question ORDER BY pos) > 1 THEN 'max_questions' END AS gone FROM f),
p AS (SELECT id, list(block ORDER BY question, pos) AS kept, bool_or(solution) AS states FROM g WHERE gone IS NULL GROUP BY id),
r AS (SELECT k.*, coalesce(kept, [coalesce(list_filter(blocks, lambda z: z LIKE '%question')[1], 'single_check_question')]) AS plan, kept IS NULL AS bare, coalesce(states, false) AS states FROM k LEFT JOIN p USING (id)),
n AS (SELECT id, gone || ' ' || block AS said FROM g WHERE gone IS NOT NULL UNION ALL SELECT id, 'unknown_supporting_strategy ' || strategy FROM x WHERE unknown UNION ALL SELECT id, 'deferred_to_next_turn ' || block FROM x WHERE later AND NOT inside
 UNION ALL SELECT id, 'empty_structure_recovered ' || plan[1] FROM r WHERE bare AND blocks IS NOT NULL UNION ALL SELECT id, 'full_solution_not_stated_this_turn' FROM r WHERE full_ok AND NOT states AND blocks IS NOT NULL
 UNION ALL SELECT id, 'no_template ' || first FROM k WHERE blocks IS NULL),
m AS (SELECT id, list(said ORDER BY said) AS actions FROM n GROUP BY id)
SELECT conv_id, turn, first AS primary_strategy, CASE WHEN blocks IS NOT NULL THEN array_to_string(plan, ' ') END AS structure, max_words, CASE WHEN blocks IS NOT NULL THEN waits END AS waits, blocks IS NOT NULL AND full_ok AND states AS full_solution,
 CASE WHEN turn % 3 = 0 THEN 'terms' ELSE 'plain words' END AS wording, coalesce(array_to_string(actions, ', '), '') AS actions FROM r LEFT JOIN m USING (id)""")
def response_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn's plan: strategies and constraints come from the turn's length and place."""
    n = F.coalesce(F.length("text"), F.lit(0))
    named = lambda c: F.concat(F.lit("S0"), (c + 1).cast("string"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", named(n % 7).alias("primary"), F.array(named(n % 5), named(n % 8), named(F.col("turn") % 6)).alias("supporting"), (n % 5 != 0).alias("direct"), (n % 3 != 0).alias("full"), (F.col("turn") % 2 == 0).alias("attempt"), F.when(F.col("turn") % 3 == 0, F.lit("advanced")).alias("level"))
    said = F.array_sort(F.transform("actions", lambda a: F.concat_ws(" ", a["rule"], a["block"])))
    p = planning.plan_responses(t, PLANNING)
    return p.select("conv_id", "turn", F.col("primary").alias("primary_strategy"), F.when(F.col("structure").isNotNull(), F.concat_ws(" ", "structure")).alias("structure"), "max_words", "waits", "full_solution", "wording", F.concat_ws(", ", said).alias("actions"))


#: What the tables are held to here: some of it holds, some does not.
DECLARED = integrity.Declared(
    rows={"documents": "doc_id", "labels": "doc_id", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "conversations": "conv_id"},
    keys=[("orders", "o_orderkey"), ("orders", "o_custkey"), ("conversations", "conv_id")],
    references=[("documents", "doc_id", "labels", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")],
    allowed=[("orders", "o_orderstatus", ["F", "O"]), ("conversations", "role", ["user", "assistant"])],
    required=[("documents", "text"), ("documents", "source"), ("conversations", "text")],
)


@query("""WITH k AS (SELECT 'orders' AS t, 'o_orderkey' AS c, CAST(o_orderkey AS VARCHAR) AS v, CAST(o_orderkey AS VARCHAR) AS r FROM orders UNION ALL SELECT 'orders', 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders
 UNION ALL SELECT 'conversations', 'conv_id', CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR) FROM conversations),
f AS (SELECT t, c, CASE WHEN v IS NULL THEN 'missing key' ELSE 'duplicate key' END AS p, v, count(*) AS n, min(r) AS r FROM k GROUP BY t, c, v HAVING v IS NULL OR count(*) > 1
UNION ALL SELECT 'documents', 'doc_id', 'unknown in labels.doc_id', CAST(doc_id AS VARCHAR), count(*), CAST(doc_id AS VARCHAR) FROM documents d WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY doc_id
UNION ALL SELECT 'customer', 'c_custkey', 'unknown in orders.o_custkey', CAST(c_custkey AS VARCHAR), count(*), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_custkey
UNION ALL SELECT 'lineitem', 'l_orderkey', 'unknown in orders.o_orderkey', CAST(l_orderkey AS VARCHAR), count(*), CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey
UNION ALL SELECT 'orders', 'o_orderstatus', 'not allowed', o_orderstatus, count(*), min(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'any') GROUP BY o_orderstatus
UNION ALL SELECT 'conversations', 'role', 'not allowed', role, count(*), min(CAST(conv_id AS VARCHAR)) FROM conversations WHERE role NOT IN ('user', 'assistant', 'any') GROUP BY role
UNION ALL SELECT 'documents', 'text', 'missing value', text, count(*), min(CAST(doc_id AS VARCHAR)) FROM documents WHERE text IS NULL OR trim(text) = '' GROUP BY text
UNION ALL SELECT 'documents', 'source', 'missing value', source, count(*), min(CAST(doc_id AS VARCHAR)) FROM documents WHERE source IS NULL OR trim(source) = '' GROUP BY source
UNION ALL SELECT 'conversations', 'text', 'missing value', text, count(*), min(CAST(conv_id AS VARCHAR)) FROM conversations WHERE text IS NULL OR trim(text) = '' GROUP BY text)
SELECT t AS "table", c AS "column", p AS problem, v AS value, n AS n_rows, r AS first_row FROM f""")
def table_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, references, allowed and required values of six tables in one report."""
    return integrity.table_findings({t: table(spark, sf, t) for t in DECLARED.rows}, DECLARED)
