"""Append-only state that outlives its process: rules, proposals, members, events and verifications.

Nothing is updated. A proposal's status is the last status event it has, a rule's
trust the last event of the rule; every change is a row more. A ledger is a folder
and nothing else: whoever opens it sees what is in it.

A batch takes the next free number, writes its tables as Parquet and is marked
done last, so half a batch never counts. What was decided on the state up to some
number is only written if the next number is still free; otherwise it is decided
anew. A number that isn't done in time is given up, and its writer can't end it.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.operators import match, verify
from tieout.sources.store import Folder, shared_dir, temporary, written

RESERVED = "auto_"
STATUS_EVENTS = {"proposed": "pending", "auto_accepted": "accepted", "accepted": "accepted", "rejected": "rejected", "pending": "pending", "review_later": "review_later"}
#: Seconds after which a batch that was begun and isn't done counts as dead.
PATIENCE_S = 900.0

_SCHEMAS = {
    "proposal": "proposal_id bigint, rule string, group_key string, edge string, member_count bigint, balance_minor bigint, has_amounts boolean, contested boolean, tolerance_minor bigint, confidence string",
    "member": "proposal_id bigint, group_key string, dataset string, row_id bigint, role string, amount_minor bigint",
    "event": "seq bigint, proposal_id bigint, kind string, actor string, detail string",
    "verification": "seq bigint, proposal_id bigint, status string, checked int, failed array<string>, invariants array<struct<code:string,passed:boolean>>",
    "rule": "seq bigint, rule string, hash string, kind string, actor string, at timestamp",
}


class RuleError(ValueError):
    """A rule that may not be registered or run under its name."""


class Conflict(RuntimeError):
    """Another writer came between reading and writing."""


def rule_hash(spec: str) -> str:
    """Digest of a rule's text; white space doesn't count."""
    return hashlib.sha256(re.sub(r"\s+", " ", spec).strip().encode()).hexdigest()


class Ledger:
    def __init__(self, spark: SparkSession, path: str | None = None, check=None) -> None:
        """The ledger of a folder, new or not. ``check(proposals, members)`` verifies at release; without it the last verification on record counts."""
        self.spark, self.check = spark, check
        self.path = (path or f"{shared_dir(spark)}/tieout-ledger-{uuid.uuid4().hex}").rstrip("/")
        self.folder = Folder(spark, self.path)
        self._marks: dict[int, dict] = {}

    # batches

    def _closed(self) -> dict[int, dict]:
        """What each number came to: {"tables": [...], "anew": bool}, or {} where it was given up. Marks don't change, so they are read once."""
        for name in self.folder.names("closed"):
            if int(name) not in self._marks and (text := self.folder.text(f"closed/{name}")):
                self._marks[int(name)] = json.loads(text)
        return self._marks

    def _batches(self) -> dict[int, list[str]]:
        """The tables of each batch that counts, by number: from the last one on that starts anew."""
        closed = self._closed()
        start = max((n for n, x in closed.items() if x.get("anew")), default=0)
        return {n: x["tables"] for n, x in sorted(closed.items()) if n >= start and x}

    def _last(self) -> int:
        """The last number taken, once all that were begun are done or given up."""
        end = time.monotonic() + PATIENCE_S
        while True:
            taken = {int(n) for n in self.folder.names("taken")}
            open_ = taken - self._closed().keys()
            if not open_:
                return max(taken, default=0)
            if time.monotonic() > end:
                for n in open_:
                    self.folder.mark(f"closed/{n:012d}", "{}")
                if time.monotonic() > end + PATIENCE_S + 60:
                    raise TimeoutError(f"what became of batches {sorted(open_)} can't be read")
            time.sleep(0.2)

    def _take(self, since: int | None) -> int:
        n = (max((int(x) for x in self.folder.names("taken")), default=0) if since is None else since) + 1
        while not self.folder.mark(f"taken/{n:012d}"):
            if since is not None:
                raise Conflict(f"batch {n} is another writer's")
            n += 1
        return n

    def _write(self, make: Callable[[int], dict[str, DataFrame]], since: int | None = None, anew: bool = False) -> int:
        """Write the tables that ``make(number)`` gives as one batch; with ``since`` only if no other batch was begun after that number."""
        n = self._take(since)
        tables = make(n)
        for name, rows in tables.items():
            fields = [f.split(" ", 1) for f in re.split(r", (?![^<]*>)", _SCHEMAS[name])]
            rows.select(*[F.col(c).cast(t).alias(c) for c, t in fields]).write.parquet(f"{self.path}/{n:012d}/{name}")
        # whoever closes a number decides what became of it
        if not self.folder.mark(f"closed/{n:012d}", json.dumps({"tables": list(tables), "anew": anew})):
            raise Conflict(f"batch {n} took too long and was given up")
        return n

    def _again(self, attempt: Callable[[int], object], tries: int = 20):
        """``attempt(last number)`` until no other writer comes between."""
        for left in reversed(range(tries)):
            try:
                return attempt(self._last())
            except Conflict:
                if not left:
                    raise

    # tables

    def table(self, name: str) -> DataFrame:
        files = [f"{self.path}/{n:012d}/{name}" for n, tables in self._batches().items() if name in tables]
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*files) if files else self.spark.createDataFrame([], _SCHEMAS[name])

    @staticmethod
    def _event(ids: DataFrame, n: int, kind: str, actor: str = "system", detail: str = "") -> DataFrame:
        return ids.select(F.lit(n).alias("seq"), "proposal_id", F.lit(kind).alias("kind"), F.lit(actor).alias("actor"), F.lit(detail).alias("detail"))

    def events(self, ids: DataFrame, kind: str, actor: str = "system", detail: str = "") -> None:
        """One event for each proposal_id of ``ids``, all with the next number."""
        self._write(lambda n: {"event": self._event(ids, n, kind, actor, detail)})

    def status(self) -> DataFrame:
        """Proposals with the status that their events come to."""
        kinds = F.create_map(*[F.lit(x) for pair in STATUS_EVENTS.items() for x in pair])
        # an event that says nothing about status leaves it
        last = self.table("event").where(F.col("kind").isin(*STATUS_EVENTS)).groupBy("proposal_id").agg(F.max_by("kind", "seq").alias("kind"))
        return self.table("proposal").join(last, "proposal_id", "left").withColumn("status", F.coalesce(kinds[F.col("kind")], F.lit("pending"))).drop("kind")

    def verified(self) -> DataFrame:
        return verify.latest(self.table("verification"))

    # rules

    def rule_states(self) -> DataFrame:
        """(rule, hash, trusted, first_seen, approved_at, approved_by) of every rule, from its events."""
        kind, at = F.col("kind"), F.col("seq")
        text, trust = kind.isin("registered", "rewritten"), kind.isin("trusted", "demoted")
        # of two first registrations the earlier one stands
        order = F.when(kind == "registered", -at).otherwise(at)
        g = self.table("rule").groupBy("rule").agg(
            F.max_by(F.when(text, F.col("hash")), F.when(text, F.struct(kind == "rewritten", order))).alias("hash"),
            F.coalesce(F.max_by(kind == "trusted", F.when(trust, at)), F.lit(False)).alias("trusted"),
            F.min("at").alias("first_seen"),
            F.max_by(F.when(trust, F.col("at")), F.when(trust, at)).alias("approved_at"),
            F.max_by(F.when(trust, F.col("actor")), F.when(trust, at)).alias("approved_by"),
        )
        return g.withColumns({c: F.when(F.col("trusted"), F.col(c)) for c in ("approved_at", "approved_by")})

    @property
    def rules(self) -> dict[str, dict]:
        """What ``rule_states`` says, by rule; rules are few, as a person or a pair of sources makes each."""
        return {r.rule: r.asDict() for r in self.rule_states().collect()}

    def _rule(self, rule: str, digest: str | None, kinds: list[str], actor: str) -> None:
        rows = self.spark.createDataFrame([(rule, digest, k) for k in kinds], "rule string, hash string, kind string")
        self._write(lambda n: {"rule": rows.withColumns({"seq": F.lit(n), "actor": F.lit(actor), "at": F.current_timestamp()})})

    def register(self, rule: str, spec: str, author: str = "system") -> dict:
        """Pin a rule's name to its text. Names of the engine's own rules are reserved; other text under a known name is refused.

        The engine's own rules are trusted from the start, and their text may
        change, as the data are their scope. A rule known without any text takes
        the text and loses trust, as nobody trusted that text.
        """
        if author != "system" and rule.startswith(RESERVED):
            raise RuleError(f"names that start with {RESERVED} are the engine's own")
        known, digest = self.rules.get(rule), rule_hash(spec)
        if known is None:
            self._rule(rule, digest, ["registered"], author)
            if author == "system":
                self._rule(rule, digest, ["trusted"], author)
        elif known["hash"] != digest and (author == "system" or known["hash"] is None):
            self._rule(rule, digest, ["rewritten"], author)
            if author != "system" and known["trusted"]:
                self._rule(rule, digest, ["demoted"], "system")
        known = self.rules[rule]
        if known["hash"] != digest:
            raise RuleError(f"{rule} stands for other text already; give the new text another name")
        return known

    def trusted(self) -> list[str]:
        return [r for r, x in self.rules.items() if x["trusted"]]

    def demote(self, rule: str, actor: str = "person") -> None:
        """Take trust from a rule: its groups wait for a person from now on; what it released stays."""
        if rule not in self.rules:
            raise RuleError(f"no rule {rule}")
        self._rule(rule, self.rules[rule]["hash"], ["demoted"], actor)

    # proposing and releasing

    def propose(self, rule: str, members: DataFrame, spec: str, tolerance_minor: int = 0, author: str = "system", check=None, note: str = "") -> dict:
        """Propose a rule's groups, verify all of them, and release those that may be without a person.

        Groups that exist, whose members were rejected together before, or that
        hold a claimed row are skipped; groups that touch a rejected row are held.
        ``check(proposals, members)`` gives verifications. Without members the rule isn't registered.
        """
        with temporary():
            props = written(match.proposals(members, rule, tolerance_minor), "proposed")
            if props.isEmpty():
                return {"rule": rule, "proposed": 0, "skipped": 0, "released": 0, "held": 0}
            self.register(rule, spec, author)
            own = written(match.members_of(props, members), "own")

            def attempt(since: int) -> tuple[DataFrame, DataFrame, DataFrame]:
                status, before = self.status(), self.table("member")
                again = props.join(status.where("status = 'rejected'").select("proposal_id"), "proposal_id", "left_semi").select("proposal_id")
                skipped = written(match.skip_reasons(props, own, status, match.claimed(status, before)).select("proposal_id").union(again).distinct(), "skipped")
                new = written(props.join(skipped, "proposal_id", "left_anti"), "new")
                kept = own.join(new.select("proposal_id"), "proposal_id", "left_semi")
                held = written(match.held_back(new, kept, match.claimed(status, before, "rejected")), "held")
                self._write(lambda n: {"proposal": new, "member": kept, "event": self._event(new, n, "proposed", author, note)}, since)
                return skipped, new, held

            skipped, new, held = self._again(attempt)
            released = 0
            if check is not None:
                self.verify(check, new)
                may = match.eligible(new, self.trusted(), held)
                released = self.release(may, "auto_accepted", "system", fresh=True)
            return {"rule": rule, "proposed": new.count(), "skipped": skipped.count(), "released": released, "held": held.count()}

    def verify(self, check, props: DataFrame | None = None) -> None:
        """Verify proposals, all by default, as one job; every run is a record more."""
        with temporary():
            props = self.table("proposal") if props is None else props
            rows = self.table("member").join(props.select("proposal_id"), "proposal_id", "left_semi")
            found = written(check(props, rows), "verified")
            self._write(lambda n: {"verification": found.withColumn("seq", F.lit(n))})

    def release(self, props: DataFrame, kind: str, actor: str, force: bool = False, fresh: bool = False, detail: str = "") -> int:
        """Accept those that pass verification now; the others get an event that says they didn't. The one way to accepted.

        ``fresh`` says that they were verified a moment ago. No row is accepted
        twice on an edge: of proposals that ask for one row at once the one with
        the smallest id gets it, and those that hold a row of an accepted one fail.
        ``force`` accepts all the same and says so.
        """
        with temporary():
            asked = written(self.table("proposal").join(props.select("proposal_id"), "proposal_id", "left_semi"), "asked")
            if self.check is not None and not fresh:
                self.verify(self.check, asked)
            last = self.verified().select("proposal_id", F.col("status").alias("checked"))
            both = written(asked.select("proposal_id", "edge").join(last, "proposal_id", "left"), "releasing")
            bad = both.where("checked IS NULL OR checked <> 'pass'")
            if not bad.isEmpty():
                self.events(bad, "verification_overridden" if force else "verification_failed", actor)
            if force:
                self.events(both, kind, actor, detail)
                return both.count()
            rest, released = both.where("checked = 'pass'").select("proposal_id", "edge"), 0
            while True:

                def attempt(since: int, rest: DataFrame = rest) -> tuple[int, DataFrame]:
                    rows = written(self.table("member").join(rest, "proposal_id").select("proposal_id", "edge", "dataset", "row_id"), "wanted")
                    late = written(rows.join(match.claimed(self.status(), self.table("member")), ["edge", "dataset", "row_id"], "left_semi").select("proposal_id").distinct(), "late")
                    free = rows.join(late, "proposal_id", "left_anti")
                    behind = free.groupBy("edge", "dataset", "row_id").agg(F.min("proposal_id").alias("first")).join(free, ["edge", "dataset", "row_id"]).where("proposal_id <> first").select("proposal_id").distinct()
                    behind = written(behind, "behind")
                    ready = written(rest.join(late, "proposal_id", "left_anti").join(behind, "proposal_id", "left_anti"), "ready")
                    self._write(lambda n: {"event": self._event(late, n, "verification_failed", actor).unionByName(self._event(ready, n, kind, actor, detail))}, since)
                    return ready.count(), behind

                done, behind = self._again(attempt)
                released += done
                if behind.isEmpty():
                    return released
                rest = rest.join(behind, "proposal_id", "left_semi")

    def trust(self, rule: str, actor: str = "person") -> int:
        """Trust a rule: its pending groups that balance exactly or within tolerance are released."""
        known = self.rules.get(rule)
        if known is None:
            raise RuleError(f"no rule {rule}")
        self._rule(rule, known["hash"], ["trusted"], actor)
        ready = self.status().where((F.col("rule") == rule) & (F.col("status") == "pending") & F.col("confidence").isin("exact", "within_tolerance"))
        with temporary():
            return self.release(written(ready, "ready"), "accepted", actor)

    def set_status(self, ids: list[int], status: str, actor: str = "person", force: bool = False, reason: str = "") -> dict[int, str]:
        """A person's decisions on up to 200 proposals; accepting goes by verification unless forced. {id: status now}, 'unknown' for ids that aren't any proposal's."""
        if status not in ("accepted", "rejected", "pending", "review_later"):
            raise ValueError(f"no status {status}")
        if len(ids) > 200:
            raise ValueError("at most 200 at a time")
        with temporary():
            picked = written(self.table("proposal").where(F.col("proposal_id").isin(*ids)), "picked")
            if status == "accepted":
                self.release(picked, "accepted", actor, force, detail=json.dumps({"reason": reason}))
            else:
                self.events(picked, status, actor, json.dumps({"reason": reason}))
        return dict.fromkeys(ids, "unknown") | {r.proposal_id: r.status for r in self.status().where(F.col("proposal_id").isin(*ids)).select("proposal_id", "status").collect()}

    def proposals(self, status: str | None = None, rule: str | None = None) -> DataFrame:
        """Proposals with their status, the newest first: by the event that proposed them, then by id."""
        made = self.table("event").groupBy("proposal_id").agg(F.min("seq").alias("made"))
        out = self.status().join(made, "proposal_id", "left")
        out = out if status is None else out.where(F.col("status") == status)
        out = out if rule is None else out.where(F.col("rule") == rule)
        return out.orderBy(F.desc("made"), "proposal_id").drop("made")

    def _rewrite(self, since: int, kept: dict[str, DataFrame]) -> None:
        """Start anew with a batch that holds ``kept``; the files of earlier ones go."""
        before = self._batches()
        self._write(lambda n: kept, since, anew=True)
        for n in before:
            self.folder.delete(f"{n:012d}")

    def clear(self) -> None:
        """Forget all rules, proposals and records; their files go."""
        self._again(lambda since: self._rewrite(since, {}))

    def compact(self) -> None:
        """The same state in one batch; a ledger of many small decisions reads faster then."""
        self._again(lambda since: self._rewrite(since, {t: self.table(t) for t in _SCHEMAS}))

    def drop_dataset(self, name: str) -> None:
        """Forget the proposals that have a member in a source, and their records."""

        def attempt(since: int) -> None:
            gone = written(self.table("member").where(F.col("dataset") == name).select("proposal_id").distinct(), "gone")
            if not gone.isEmpty():
                self._rewrite(since, {t: self.table(t) if t == "rule" else self.table(t).join(gone, "proposal_id", "left_anti") for t in _SCHEMAS})

        with temporary():
            self._again(attempt)

    def list_rules(self) -> DataFrame:
        """(rule, trusted, first_seen, approved_at, approved_by, total, pending), the newest rules first."""
        counts = self.status().groupBy("rule").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))
        return self.rule_states().drop("hash").join(counts, "rule", "left").fillna(0, ["total", "pending"]).orderBy(F.desc("first_seen"), "rule")

    def detail(self, proposal_id: int, marks: DataFrame | None = None) -> dict:
        """A proposal with its members, events and last verification; with ``marks`` (dataset, row_id, dup_of) also what its duplicate members add to its balance."""
        pick = F.col("proposal_id") == proposal_id
        members = self.table("member").where(pick)
        out = {"proposal": self.status().where(pick), "members": members, "events": self.table("event").where(pick).orderBy("seq"), "verification": self.verified().where(pick)}
        if marks is not None:
            note = match.duplicate_note(match.duplicate_members(members, marks.where("dup_of IS NOT NULL")))
            out["duplicates"] = match.explained(note, out["proposal"])
        return out
