"""Table-driven decisions over turns.

turns: turn_id, intent, learner_state, student_level, special_handling (facts)
trigger rows: id, the four keys (a value or ``any``), primary, supporting, priority
policy rows: id, condition columns (null: silent), precedence, permissions, ...
The rule tables are small dimensions; Spark broadcasts them by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

KEYS = ("intent", "learner_state", "student_level", "special_handling")


def _agrees(key: str) -> Column:
    return (F.col(f"r.{key}") == "any") | (F.col(f"r.{key}") == F.col(f"f.{key}"))


def trigger_matches(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """Every matching row of each turn with its rank and what it lost to and on."""
    on = _agrees(KEYS[0])
    for key in KEYS[1:]:
        on = on & _agrees(key)
    j = turns.alias("f").join(rows.alias("r"), on)
    fit = sum((F.when(F.col(f"r.{key}") == "any", 0).otherwise(1) for key in KEYS), F.lit(0))
    m = j.select("f.turn_id", F.col("r.id").alias("row_id"), "r.primary", "r.supporting", "r.priority", fit.alias("specificity"))
    w = Window.partitionBy("turn_id").orderBy(F.desc("priority"), F.desc("specificity"), "row_id")
    ranked = m.withColumn("rank", F.row_number().over(w))
    top = {c: F.first(c).over(w) for c in ("row_id", "priority", "specificity")}
    lost = F.when(F.col("rank") > 1, top["row_id"])
    why = F.when(F.col("rank") == 1, F.lit(None)).when(F.col("priority") < top["priority"], F.lit("priority")).when(F.col("specificity") < top["specificity"], F.lit("specificity")).otherwise(F.lit("id"))
    return ranked.withColumn("lost_to", lost).withColumn("lost_on", why)


def select_trigger(turns: DataFrame, rows: DataFrame, fallback: tuple[str, str]) -> DataFrame:
    """The winning row of each turn; ``fallback`` (id, primary) and matched false where none fits."""
    best = trigger_matches(turns, rows).filter("rank = 1").select("turn_id", "row_id", "primary", "supporting")
    j = turns.join(best, "turn_id", "left")
    return j.withColumns({"matched": F.col("row_id").isNotNull(), "row_id": F.coalesce("row_id", F.lit(fallback[0])), "primary": F.coalesce("primary", F.lit(fallback[1])), "supporting": F.coalesce("supporting", F.array().cast("array<string>"))})


def ambiguous(rows: DataFrame) -> DataFrame:
    """Keys that several rows of one priority share."""
    return rows.groupBy(*KEYS, "priority").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)


def combine(primary: Column, supporting: Column, hints: list[str], answers: list[str], allowed: Column, most: int = 2) -> Column:
    """Primary, supporting and what was dropped and why, under the combination rules.

    A hint beats a full answer in the same turn and takes the primary slot;
    then only allowed strategies stay, none twice, ``most`` at most.
    """
    h, a = F.array(*map(F.lit, hints)), F.array(*map(F.lit, answers))
    every = F.concat(F.array(primary), supporting)
    clash = F.arrays_overlap(every, h) & F.arrays_overlap(every, a)
    first = F.get(F.array_intersect(every, h), F.lit(0))
    head = F.when(clash & ~F.array_contains(h, primary), first).otherwise(primary)
    rest = F.when(clash, F.array_except(F.filter(supporting, lambda s: s != head), a)).otherwise(supporting)
    lost = F.when(clash, F.array_intersect(every, a)).otherwise(F.expr("cast(array() as array<string>)"))
    fit = F.filter(F.array_distinct(F.filter(rest, lambda s: s != head)), lambda s: F.array_contains(allowed, s))
    kept = F.slice(fit, 1, most)
    actions = F.concat(
        F.transform(lost, lambda s: F.struct(F.lit("hint_first_beats_full_answer").alias("rule"), s.alias("dropped"))),
        F.transform(F.filter(rest, lambda s: s == head), lambda s: F.struct(F.lit("no_duplicate_primary").alias("rule"), s.alias("dropped"))),
        F.transform(F.filter(rest, lambda s: (s != head) & ~F.array_contains(allowed, s)), lambda s: F.struct(F.lit("not_allowed").alias("rule"), s.alias("dropped"))),
        F.transform(F.array_except(fit, kept), lambda s: F.struct(F.lit("cap").alias("rule"), s.alias("dropped"))),
    )
    return F.struct(head.alias("primary"), kept.alias("supporting"), actions.alias("actions"))


def applicable(turns: DataFrame, policies: DataFrame, conditions: tuple[str, ...]) -> DataFrame:
    """Policies of each turn: the baseline (no condition) always, others where all conditions agree."""
    on = F.lit(True)
    for c in conditions:
        on = on & (F.col(f"p.{c}").isNull() | F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")))
    return turns.alias("f").join(policies.alias("p"), on).select("f.turn_id", "p.*")


def fold_policies(rows: DataFrame, permissions: tuple[str, ...]) -> DataFrame:
    """Permissions AND, the attempt vote OR with null silent, prohibitions united, the top row named."""
    out = [F.every(p).alias(p) for p in permissions]
    sets = F.array_sort(F.array_distinct(F.flatten(F.collect_list("prohibited")))).alias("prohibited")
    return rows.groupBy("turn_id").agg(*out, F.some("attempt_required").alias("attempt_required"), sets, F.max_by("id", F.struct("precedence", "id")).alias("top_policy"), F.count(F.lit(1)).alias("n_policies"))


def veto(primary: Column, prohibited: Column, substitute: str) -> Column:
    return F.when(F.array_contains(prohibited, primary), F.lit(substitute)).otherwise(primary)


def route_evaluation(primary: Column, evaluation: Column, answer_strategy: str = "S06", recovery: str = "S07") -> Column:
    """Only the checking strategy carries a verdict; one that can't be reached goes to recovery."""
    return F.when((primary == answer_strategy) & (evaluation == "cannot_evaluate"), F.lit(recovery)).otherwise(primary)


def confidence_floor(df: DataFrame, floor: float = 0.6, default: str = "explain") -> DataFrame:
    """An uncertain intent becomes the default; the raw one is kept."""
    low = F.col("confidence") < floor
    return df.withColumn("raw_intent", F.col("intent")).withColumn("intent", F.when(low, F.lit(default)).otherwise(F.col("intent")))


def knowledge_rules(turns: DataFrame, rules: DataFrame, reached: DataFrame) -> DataFrame:
    """The highest-priority enabled rule whose requirement holds.

    rules: id, enabled, priority, learner_state, intent, relation, max_distance;
    reached: turn_id, relation, distance, node.
    """
    cond = F.col("r.enabled") & (F.col("r.learner_state").isNull() | (F.col("r.learner_state") == F.col("f.learner_state"))) & (F.col("r.intent").isNull() | (F.col("r.intent") == F.col("f.intent")))
    j = turns.alias("f").join(rules.alias("r"), cond).select("f.turn_id", "r.id", "r.priority", "r.relation", "r.max_distance")
    near = reached.groupBy("turn_id", "relation").agg(F.min("distance").alias("distance"), F.min_by("node", F.struct("distance", "node")).alias("target"))
    ok = j.join(near, ["turn_id", "relation"], "left").filter(F.col("relation").isNull() | (F.col("distance") <= F.coalesce("max_distance", F.lit(99))))
    w = Window.partitionBy("turn_id").orderBy(F.desc("priority"), "id")
    return ok.withColumn("k", F.row_number().over(w)).filter("k = 1").select("turn_id", F.col("id").alias("rule_id"), "target")


def plan_blocks(structure: Column, kinds: dict[str, str], allow_solution: Column, most_questions: int = 1) -> Column:
    """A template's blocks without solutions where they are withheld, and at most so many questions."""
    kind = lambda b: F.coalesce(*[F.when(b == n, F.lit(v)) for n, v in kinds.items()], F.lit("text"))
    allowed = F.filter(structure, lambda b: allow_solution | (kind(b) != "solution"))
    asked = F.slice(F.filter(allowed, lambda b: kind(b) == "question"), 1, most_questions)
    return F.filter(allowed, lambda b: (kind(b) != "question") | F.array_contains(asked, b))


def guard(draft: Column, secret: Column, attempt: Column, withheld: Column) -> Column:
    """pass, regenerate (first draft) or fallback by whether a withheld answer shows."""
    found = F.size(tx.find_leaks(draft, secret))
    return F.when(~withheld | (found <= 0), F.lit("pass")).when(attempt == 0, F.lit("regenerate")).otherwise(F.lit("fallback"))


def over_limit(words: Column, limit: Column, tolerance: float = 1.25) -> Column:
    return words > limit * F.lit(tolerance)


def sticky(turns: DataFrame, value: str, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """The last value set in a session up to each turn."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn(f"active_{value}", F.last(value, ignorenulls=True).over(w))


def context(turns: DataFrame, n: int = 6, session: str = "session_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The ``n`` messages before each turn, oldest first."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(-n, -1)
    return turns.withColumn("context", F.collect_list(text).over(w))


def pick_item(items: DataFrame, asked: DataFrame, solved: DataFrame) -> DataFrame:
    """A session's quiz item: unseen and unsolved, else unsolved, else the first.

    items: session_id, topic, item_id, pos; asked, solved: session_id, item_id.
    """
    j = items.join(asked.select("session_id", "item_id", F.lit(1).alias("a")).distinct(), ["session_id", "item_id"], "left").join(solved.select("session_id", "item_id", F.lit(1).alias("s")).distinct(), ["session_id", "item_id"], "left")
    w = Window.partitionBy("session_id").orderBy(F.coalesce("s", F.lit(0)), F.coalesce("a", F.lit(0)), "pos")
    return j.withColumn("k", F.row_number().over(w)).filter("k = 1").select("session_id", "item_id")


#: fixed values: confidences of the ways in which a message names a topic
EXACT, MENTION, FUZZY, FRAGMENT, CONTEXT_ONLY = 1.0, 0.9, 0.75, 0.6, 0.4
#: fixed values: the least likeness of a misspelt label, and the least length of a label or message that counts inside another
FUZZY_CUTOFF, FRAGMENT_CHARS = 0.82, 4


def _grams(text: str, n: int) -> Column:
    """The distinct substrings of ``n`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n))))


def _label_pairs(m: DataFrame, names: DataFrame) -> DataFrame:
    """``text, label`` pairs that may match, by equality, shared starts or shared pairs of letters; none is left out.

    A label inside a message has its first four letters there, and the reverse.
    Texts as alike as ``FUZZY_CUTOFF`` share two letters in a row and differ in
    length by less than half.
    """
    four = FRAGMENT_CHARS
    texts, labels = m.select("text").distinct(), names.select("label").distinct()
    same = texts.join(labels, F.col("text") == F.col("label"))
    long_texts, long_labels = texts.filter(F.length("text") >= four), labels.filter(F.length("label") >= four)
    inside = long_texts.select("text", F.explode(_grams("text", four)).alias("g")).join(long_labels.withColumn("g", F.substring("label", 1, four)), "g").filter(F.col("text").contains(F.col("label")))
    part = long_labels.select("label", F.explode(_grams("label", four)).alias("g")).join(long_texts.withColumn("g", F.substring("text", 1, four)), "g").filter(F.col("label").contains(F.col("text")))
    least, whole = F.least(F.length("text"), F.length("label")), F.length("text") + F.length("label")
    most = labels.agg(F.max(F.length("label")).alias("most"))  # one row
    near = texts.filter(F.length("text") > 1).join(F.broadcast(most), F.length("text") <= F.col("most") * (2 / FUZZY_CUTOFF - 1)).select("text", F.explode(_grams("text", 2)).alias("g"))
    near = near.join(labels.filter(F.length("label") > 1).select("label", F.explode(_grams("label", 2)).alias("g")), "g").filter(2 * least >= FUZZY_CUTOFF * whole)
    return reduce(DataFrame.unionByName, [x.select("text", "label") for x in (same, inside, part, near)]).distinct()


def resolve_topics(messages: DataFrame, labels: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """``message_id, topic_id, confidence, matched_on, ambiguous, resolved_by_context``.

    A label scores by the first that holds: the message is the label (1.0), has
    it inside (0.9), is as alike as 0.82 (up to 0.75), is inside it (0.6).  Of the
    topics with the best score those go whose label is inside another's.  Several
    left: the most recent topic of the conversation among them, else the first in
    teaching order at half the confidence, ambiguous.  None: the most recent
    topic at 0.4.  labels: topic_id, seq, label; messages: message_id, text; both
    normalised; recent: message_id, pos (0 the most recent), topic_id.
    """
    m = messages.select("message_id", "text").filter("text <> ''")
    names = labels.select("topic_id", "seq", "label").filter("label <> ''").distinct()
    pairs = _label_pairs(m, names)
    ratio = F.when(F.col("text") == F.col("label"), 1.0).otherwise(tx.gestalt(F.col("text"), F.col("label")))
    inside = (F.length("label") >= FRAGMENT_CHARS) & F.col("text").contains(F.col("label"))
    part = (F.length("text") >= FRAGMENT_CHARS) & F.col("label").contains(F.col("text"))
    rated = pairs.withColumn("ratio", ratio)
    near = F.col("ratio") >= FUZZY_CUTOFF
    tier = lambda exact, mention, fuzzy, fragment: F.when(F.col("text") == F.col("label"), exact).when(inside, mention).when(near, fuzzy).when(part, fragment)
    rated = rated.select("text", "label", tier(F.lit(EXACT), F.lit(MENTION), F.bround(F.col("ratio") * FUZZY, 4), F.lit(FRAGMENT)).alias("score"), tier(*map(F.lit, ("exact", "mention", "fuzzy", "fragment"))).alias("how")).filter("score is not null")
    scored = m.join(rated, "text").join(names, "label")
    # of a topic's labels with the best score the longest is the one that was named
    one = F.row_number().over(Window.partitionBy("message_id", "topic_id").orderBy(F.desc("score"), F.desc(F.length("label")), "label"))
    best = scored.withColumn("k", one).filter("k = 1").withColumn("top", F.max("score").over(Window.partitionBy("message_id"))).filter("score = top")
    others = F.collect_set("label").over(Window.partitionBy("message_id"))
    kept = best.withColumn("others", others).filter(~F.exists("others", lambda o: (o != F.col("label")) & o.contains(F.col("label"))))
    n = kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("message_id")))
    if recent is None:
        recent = messages.sparkSession.createDataFrame([], f"message_id {messages.schema['message_id'].dataType.simpleString()}, pos int, topic_id {labels.schema['topic_id'].dataType.simpleString()}")
    before = recent.groupBy("message_id", "topic_id").agg(F.min("pos").alias("pos"))
    ranked = n.join(before, ["message_id", "topic_id"], "left").withColumn("k", F.row_number().over(Window.partitionBy("message_id").orderBy(F.asc_nulls_last("pos"), "seq", "topic_id"))).filter("k = 1")
    helped = (F.col("n") > 1) & F.col("pos").isNotNull()
    unclear = (F.col("n") > 1) & F.col("pos").isNull()
    named = ranked.select("message_id", "topic_id", F.when(unclear, F.bround(F.col("score") * 0.5, 4)).otherwise(F.col("score")).alias("confidence"), F.col("how").alias("matched_on"), unclear.alias("ambiguous"), helped.alias("resolved_by_context"))
    carried = before.join(names.select("topic_id").distinct(), "topic_id", "left_semi").groupBy("message_id").agg(F.min_by("topic_id", "pos").alias("topic_id")).join(messages.select("message_id"), "message_id", "left_semi").join(named, "message_id", "left_anti")
    return named.unionByName(carried.select("message_id", "topic_id", F.lit(CONTEXT_ONLY).alias("confidence"), F.lit("conversation_context").alias("matched_on"), F.lit(False).alias("ambiguous"), F.lit(True).alias("resolved_by_context")))


def topic_by_key(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, topic_id``: the topic whose id is the key, else the first in teaching order with such a label; texts normalised."""
    named = keys.select("key").distinct()
    by_id = named.join(labels.select(F.col("topic_id").alias("_id"), "topic_id", "seq", tx.plain_text(F.col("topic_id")).alias("label")).distinct(), F.col("key") == F.col("label")).select("key", "topic_id", "seq", F.lit(0).alias("tier"))
    by_label = named.join(labels, F.col("key") == F.col("label")).select("key", "topic_id", "seq", F.lit(1).alias("tier"))
    return by_id.unionByName(by_label).groupBy("key").agg(F.min_by("topic_id", F.struct("tier", "seq", "topic_id")).alias("topic_id"))


def onboarding(answers: DataFrame, labels: DataFrame, levels: tuple[str, ...] = ("beginner", "intermediate", "advanced")) -> DataFrame:
    """``student_id, topic_id, level`` from answers ``student_id, key, level, seq``: the last one about a topic holds;
    unknown topics and levels are left out."""
    known = answers.filter(F.col("level").isin(*levels)).join(topic_by_key(answers, labels), "key")
    return known.groupBy("student_id", "topic_id").agg(F.max_by("level", "seq").alias("level"))


def level_for(turns: DataFrame, levels: DataFrame, default: str = "beginner") -> DataFrame:
    """The declared level of a turn's topic, or the default and its source."""
    j = turns.join(levels.select("student_id", "topic", "level"), ["student_id", "topic"], "left")
    declared = F.col("level").isNotNull() & (F.col("level") != default)
    return j.withColumn("level_source", F.when(declared, F.lit("declared")).otherwise(F.lit(f"default_{default}"))).withColumn("level", F.coalesce("level", F.lit(default)))


def questionnaire(topics: DataFrame, levels: tuple[str, ...] = ("beginner", "intermediate", "advanced")) -> DataFrame:
    """A question per topic with all levels as options."""
    return topics.select("topic_id", "name", F.explode(F.array(*map(F.lit, levels))).alias("level"))


def problem_for(messages: DataFrame, problems: DataFrame) -> DataFrame:
    """The problem a message is about: its statement inside it, or all its numbers in order (two at least).

    The longest statement wins, the first among equals.  Texts are folded
    without spaces; numbers are arrays of exact values.
    """
    inside = F.col("m.folded").contains(F.col("p.folded"))
    line = (F.size("p.numbers") >= 2) & tx.is_subsequence(F.col("m.numbers"), F.col("p.numbers"))
    j = messages.alias("m").join(F.broadcast(problems.alias("p")), inside | line)
    return j.groupBy("m.message_id").agg(F.max_by("p.problem_id", F.struct(F.length("p.folded"), -F.col("p.pos"))).alias("problem_id"))


def coverage(secret_numbers: Column, prose: Column) -> Column:
    """What a leak scan of a key can see: exact and folded text always, numbers only where it has any."""
    base = F.array(F.lit("exact"), F.lit("normalised"))
    return F.when(F.coalesce(F.length(F.trim(prose)), F.lit(0)) == 0, F.expr("cast(array() as array<string>)")).when(F.size(secret_numbers) > 0, F.concat(base, F.array(F.lit("final_answer"), F.lit("numeric_token")))).otherwise(base)


def reconcile(model: Column, checker: Column) -> Column:
    """The checker's verdict where it has one, else the model's; who decided is told."""
    return F.struct(F.coalesce(checker, model, F.lit("cannot_evaluate")).alias("evaluation"), F.when(checker.isNotNull(), F.lit("checker")).when(model.isNotNull(), F.lit("model")).otherwise(F.lit("nobody")).alias("decided_by"), (checker.isNotNull() & model.isNotNull() & (checker != model)).alias("overruled"))


#: fixed values: phrases that press for a verdict
PRESSURE = (
    r"i['’]?\s*m\s+(?:absolutely\s+|totally\s+|pretty\s+|quite\s+|very\s+)?(?:sure|certain|positive|confident)",
    r"i\s+am\s+(?:absolutely\s+|totally\s+|pretty\s+|quite\s+|very\s+)?(?:sure|certain|positive|confident)",
    r"(?:my|the)\s+(?:notes?|textbook|book|teacher|tutor|professor|friend)\s+(?:says?|said|told\s+me)(?:\s+so)?",
    r"(?:it|that|this)['’]?s\s+(?:definitely\s+|obviously\s+|certainly\s+)?(?:right|correct)",
    r"(?:it|that|this)\s+is\s+(?:definitely\s+|obviously\s+|certainly\s+)?(?:right|correct)",
    r"i\s+(?:know|got)\s+(?:it|this)\s+(?:is\s+)?right",
    r"trust\s+me",
    r"believe\s+me",
    r"for\s+sure",
    r"100\s*%\s*(?:sure|certain)?",
    r"\bdefinitely\b",
    r"\bobviously\b",
    r"\bsurely\b",
    r"just\s+(?:confirm|agree|say\s+yes)",
    r"right\s*\?",
    r"isn['’]?t\s+it\s*\??",
    r"(?:ผม|หนู|ฉัน|เรา)?มั่นใจ(?:ว่า|มาก|เลย)?",
    r"(?:ครู|อาจารย์|ติวเตอร์)บอกว่า",
    r"ใน(?:สมุด|หนังสือ)เขียนว่า",
    r"แน่นอน(?:อยู่แล้ว)?",
    r"ถูกแน่ ?ๆ",
    r"ต้องถูก(?:แน่ ?ๆ)?",
    r"เชื่อ(?:ผม|หนู|ฉัน)เถอะ",
)
#: fixed value: what is left of punctuation where a phrase went
_STRANDED = r"\s*[.,;:!?—–-]\s*(?=[.,;:!?—–-]|$)"


def strip_pressure(text: Column) -> Column:
    """The text without phrases that press for a verdict, and those phrases in their order."""
    wide = lambda pattern: pattern.replace(r"\s", tx.SPACE)
    phrases = "(?iU)" + wide("|".join(PRESSURE))
    ends = lambda c: F.regexp_replace(c, f"^{tx.SPACE}+|{tx.SPACE}+$", "")
    removed = F.transform(F.regexp_extract_all(text, F.lit(phrases), F.lit(0)), ends)
    left = F.regexp_replace(F.regexp_replace(text, phrases, " "), tx.SPACE + "+", " ")
    clean = F.regexp_replace(F.regexp_replace(left, wide(_STRANDED), ""), r"^[ \t\n.,;:!?—–-]+|[ \t\n.,;:!?—–-]+$", "")
    return F.struct(F.when(F.size(removed) > 0, clean).otherwise(ends(text)).alias("text"), removed.alias("removed"))


def plan_problems(plans: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Plans that break an invariant (none should): ``turn_id, problem``. plans: turn_id, blocks, solution, max_words."""
    kind = lambda b: F.coalesce(*[F.when(b == n, F.lit(v)) for n, v in kinds.items()], F.lit("text"))
    shows = F.exists("blocks", lambda b: kind(b) == "solution")
    asks = F.size(F.filter("blocks", lambda b: kind(b) == "question"))
    why = F.array(F.when(shows & ~F.col("solution"), F.lit("solution withheld but planned")), F.when(asks > 1, F.lit("more than one question")), F.when(F.size("blocks") == 0, F.lit("empty plan")), F.when(F.col("max_words") <= 0, F.lit("no words allowed")))
    return plans.select("turn_id", F.explode(F.array_compact(why)).alias("problem"))


def may_state_solution(blocks: Column, kinds: dict[str, str], allowed: Column) -> Column:
    """Whether policy allows a solution and a solution block is left."""
    return allowed & F.exists(blocks, lambda b: F.coalesce(*[F.when(b == n, F.lit(v == "solution")) for n, v in kinds.items()], F.lit(False)))


def recent_topics(turns: DataFrame, session: str = "session_id", turn: str = "turn", topic: str = "topic") -> DataFrame:
    """The topics of the turns before, the most recent first, each once."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("recent_topics", F.array_distinct(F.reverse(F.collect_list(topic).over(w))))


def live_map(versions: DataFrame) -> DataFrame:
    """Per course the version that holds: live, else draft, else seed; drafts with errors can't go live."""
    rank = F.when(F.col("kind") == "live", 0).when(F.col("kind") == "draft", 1).otherwise(2)
    w = Window.partitionBy("course_id").orderBy(rank)
    return versions.withColumn("approvable", (F.col("kind") == "draft") & (F.col("errors") == 0)).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def turn_events(turns: DataFrame) -> DataFrame:
    """A turn's stream as rows: traces, text pieces of 24 characters, then done or error."""
    pieces = F.transform(tx.chunks_of(F.col("text")), lambda p: F.struct(F.lit("token").alias("event"), p.alias("data")))
    trace = F.transform("steps", lambda s: F.struct(F.lit("trace").alias("event"), s.alias("data")))
    end = F.array(F.struct(F.when(F.col("error").isNull(), F.lit("done")).otherwise(F.lit("error")).alias("event"), F.coalesce("error", F.lit("")).alias("data")))
    rows = F.concat(trace, F.when(F.col("error").isNull(), pieces).otherwise(F.slice(pieces, 1, 0)), end)
    return turns.select("turn_id", F.posexplode(rows).alias("event_seq", "e")).select("turn_id", "event_seq", "e.event", "e.data")
