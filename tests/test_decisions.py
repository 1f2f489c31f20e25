"""Turn decisions against a plain walk through the steps."""

import random

from weftgraph import catalogue, catalogue_sets
from weftgraph.operators import decisions

C = catalogue_sets.TOGETHER


class Turn:
    def __init__(self, row):
        self.primary, self.supporting, self.verdict = row["primary"], list(row["supporting"]), row["evaluation"]
        self.trace = [f"trigger {'matched' if row['matched'] else 'unmatched'} {row['row_id']} - {row['primary']}"]

    def say(self, step, rule, source="-", gone="-", come="-"):
        self.trace.append(f"{step} {rule} {source} {gone} {come}")

    def combine(self, step):
        every = [self.primary, *self.supporting]
        hints, answers = [s for s in every if s in C.hints], [s for s in every if s in C.answers]
        if hints and answers:
            for a in answers:
                self.say(step, "hint_first_beats_full_answer", gone=a)
            head = self.primary if self.primary in C.hints else hints[0]
            if head != self.primary:
                self.say(step, "hint_first_beats_full_answer", gone=self.primary, come=head)
            self.supporting = [s for s in self.supporting if s not in C.answers and s != head]
            self.primary = head
        kept = []
        for s in self.supporting:
            if s == self.primary:
                self.say(step, "no_duplicate_primary", gone=s)
            elif s not in C.allowed.get(self.primary, []):
                self.say(step, "allowed_combinations", gone=s)
            else:
                kept.append(s)
        for s in kept[C.most :]:
            self.say(step, "max_supporting", gone=s)
        self.supporting = kept[: C.most]

    def route(self):
        if self.primary != C.feedback:
            if self.verdict:
                self.say("evaluation", "evaluation_requires_feedback", gone=self.verdict)
            self.verdict = None
        elif self.verdict == "cannot_evaluate":
            self.say("evaluation", "cannot_evaluate_routes_to_check", gone=self.primary, come=C.no_verdict)
            kept = [s for s in self.supporting if s in C.allowed[C.no_verdict] and s != C.no_verdict]
            for s in self.supporting:
                if s not in kept:
                    self.say("evaluation", "allowed_combinations", gone=s)
            self.primary, self.supporting, self.verdict = C.no_verdict, kept, None

    def policy(self, rows):
        rows = sorted(rows, key=lambda p: -p["precedence"])
        if not rows:
            self.say("policy", "no_policy_row")
            self.combine("policy")
            return {"direct": False, "full": False, "attempt": False, "prohibited": [], "policy": None}
        direct = all(p["direct"] for p in rows)
        out = {s for p in rows for s in p["prohibited"]}
        if not all(p["allow_hints"] for p in rows):
            out |= set(C.hints)
        if not direct:
            out |= set(C.answers)
        named = next((p for p in rows if not p["direct"]), rows[0])["id"]
        rule = lambda s: "policy_vetoes_direct_answer" if s in C.answers else "policy_prohibits_strategy"
        if self.primary in out:
            new = next((s for s in [*(p["veto_primary"] for p in rows if p["veto_primary"]), *sorted(C.hints), *sorted(C.checks)] if s not in out), None)
            if new:
                self.say("policy", rule(self.primary), named, self.primary, new)
                self.primary, self.supporting = new, [s for s in self.supporting if s != new]
        for s in [s for s in self.supporting if s in out]:
            self.say("policy", rule(s), named, s)
        self.supporting = [s for s in self.supporting if s not in out]
        if not all(p["allow_check"] for p in rows):
            for s in [s for s in self.supporting if s in C.checks]:
                self.say("policy", "policy_disallows_check", named, s)
            self.supporting = [s for s in self.supporting if s not in C.checks]
        if all(p["allow_hints"] for p in rows) and any(p["hint_first"] for p in rows) and not {self.primary, *self.supporting} & set(C.hints):
            hint = next((h for h in sorted(C.hints) if h in C.allowed.get(self.primary, [])), None)
            if hint:
                self.supporting.insert(0, hint)
                self.say("policy", "policy_requires_hint_first", named, come=hint)
        self.combine("policy")
        return {"direct": direct, "full": all(p["full"] for p in rows), "attempt": any(p["attempt"] for p in rows if p["attempt"] is not None), "prohibited": sorted(out), "policy": named}


NAMES = ("id", "intent", "special_handling", "precedence", "direct", "full", "attempt", "hint_first", "allow_hints", "allow_check", "prohibited", "veto_primary")


def expected(row, policies):
    t = Turn(row)
    t.combine("combination")
    t.route()
    more = t.policy([p for p in policies if all(p[c] is None or p[c] == row[c] for c in ("intent", "special_handling"))])
    t.say("final", "chosen", more["policy"] or "-", come=t.primary)
    return (row["turn_id"], t.primary, t.supporting, t.verdict, more["direct"], more["full"], more["attempt"], more["prohibited"], more["policy"], t.trace)


def flat(r):
    said = [" ".join(x or "-" for x in e) for e in r.trace]
    return (r.turn_id, r.primary, r.supporting, r.evaluation, r.direct, r.full, r.attempt, r.prohibited, r.policy, said)


def test_random_turns_and_policies(spark):
    r = random.Random(8)
    ids = [f"S0{k}" for k in range(8)]
    rows = [{"turn_id": k, "intent": r.choice(["solve", "review", None]), "special_handling": r.choice(["none", "pressure"]), "row_id": "T", "matched": r.random() < 0.8, "primary": r.choice(ids), "supporting": [r.choice(ids) for _ in range(r.randrange(5))], "evaluation": r.choice([None, "correct", "cannot_evaluate"])} for k in range(400)]
    flag = lambda: r.random() < 0.6
    policies = [dict(zip(NAMES, (f"P{k}", r.choice([None, "solve", "review"]), r.choice(["none", "pressure"]), r.randrange(4), flag(), flag(), r.choice([None, True, False]), flag(), flag(), flag(), r.sample(ids, r.randrange(3)), r.choice([None, *ids])))) for k in range(6)]
    policies = [p for p in policies if p["special_handling"] != "none" or p["intent"]]  # some turns have no row
    turns = spark.createDataFrame([tuple(x.values()) for x in rows], "turn_id long, intent string, special_handling string, row_id string, matched boolean, primary string, supporting array<string>, evaluation string")
    df = spark.createDataFrame([(*list(p.values())[:4], k, *list(p.values())[4:]) for k, p in enumerate(policies)], "id string, intent string, special_handling string, precedence int, seq int, direct boolean, full boolean, attempt boolean, hint_first boolean, allow_hints boolean, allow_check boolean, prohibited array<string>, veto_primary string")
    got = {x.turn_id: flat(x) for x in decisions.decide(turns, df, C).collect()}
    for row in rows:
        assert got[row["turn_id"]] == expected(row, policies), repr((row, got[row["turn_id"]], expected(row, policies)))


def test_every_turn_of_the_conversations(spark):
    sf = "/root/testdata/sf0.01"
    policies = [dict(zip(NAMES, p)) for p in catalogue_sets.TEACHING]
    got = {r.turn_id: tuple(r) for r in catalogue.QUERIES["turn_decisions"](spark, sf).collect()}
    from weftgraph.operators import rules

    facts = catalogue.facts(spark, sf)
    for r in rules.select_trigger(facts, catalogue.trigger_rows(spark), ("T99", "S00")).collect():
        row = r.asDict() | {"evaluation": {0: "correct", 1: "cannot_evaluate"}.get(r.turn_id % 4)}
        assert got.pop(r.turn_id) == expected(row, policies)
    assert not got
