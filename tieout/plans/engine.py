"""The engine's facade: discover, match, verify, release, and what came of it."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.expr import instant_micros, slug
from tieout.operators.dedup import duplicate_summary
from tieout.operators import amounts, chains, discover, embedded, match, profile, report, spine, timing, verify
from tieout.plans.ledger import Ledger
from tieout.plans.sqlgate import analysed, run_select
from tieout.sources.catalog import Catalog
from tieout.sources.store import written


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.catalog = spark, Catalog(spark)
        self.ledger = Ledger(spark, path, self.checks)
        self.spine_declared: str | None = None
        self.views: dict[str, DataFrame] = {}
        self._index: tuple | None = None

    # catalog and queries

    def list_datasets(self) -> list[dict]:
        return self.catalog.list()

    def describe_dataset(self, name: str) -> dict:
        d = self.catalog.datasets[name]
        return self.catalog.describe(name) | {"profile": profile.profile(d.rows, list(d.kinds))}

    def query_data(self, sql: str, rows: int = 10) -> dict:
        return run_select(self.spark, sql, rows, tables=self.tables())

    def tables(self) -> list[str]:
        """The views that SQL may read: the sources, and what was made of them."""
        return [*self.catalog.datasets, *[f"v_{n}_norm" for n in self.views]]

    def drop_dataset(self, name: str) -> None:
        """Delete a source with its views and all proposals that hold a row of it."""
        self.ledger.drop_dataset(name)
        if self.views.pop(name, None) is not None:
            self.spark.catalog.dropTempView(f"v_{name}_norm")
        self.catalog.drop(name)

    def reset(self) -> None:
        """Forget every source, view, rule and proposal."""
        for name in list(self.catalog.datasets):
            if self.views.pop(name, None) is not None:
                self.spark.catalog.dropTempView(f"v_{name}_norm")
        self.catalog.reset()
        self.ledger.clear()
        self.spine_declared = None

    def visible(self) -> dict[str, DataFrame]:
        return {n: self.views.get(n, d.visible()) for n, d in self.catalog.datasets.items()}

    def sources(self) -> dict[str, DataFrame]:
        """Rows of every source, without marks, as verification reads them."""
        return {n: d.rows.select("row_id", *d.kinds) for n, d in self.catalog.datasets.items()}

    # the automatic pass

    def normalise(self) -> list[str]:
        """Give sources with credit and debit columns a signed amount."""
        done = []
        for n, d in self.catalog.datasets.items():
            pair = amounts.signed_pair(d.rows, d.number_columns)
            if pair and "signed_amount" not in d.rows.columns:
                a, b = (F.coalesce(F.col(c), F.lit(0)) for c in pair)
                self.views[n] = d.visible().withColumn("signed_amount", a - b)
                self.views[n].createOrReplaceTempView(f"v_{n}_norm")
                done.append(f"v_{n}_norm")
        return done

    def pairs(self, min_coverage: float = discover.USABLE_COVERAGE) -> tuple[DataFrame, DataFrame]:
        """(values of all columns, usable pairs of columns)."""
        values, overlap = self.overlap()
        return values, discover.usable_pairs(overlap, {n: d.text_columns for n, d in self.catalog.datasets.items()}, min_coverage)

    def overlap(self) -> tuple[DataFrame, DataFrame]:
        """(values of all columns, overlap of all pairs of columns), built once for what the catalog holds and which rows count."""
        sets, rows = self.catalog.datasets, self.visible()
        state = [(n, id(rows[n]), tuple(d.kinds), d.exclude_duplicates) for n, d in sets.items()]
        if self._index is None or self._index[0] != state:
            values = written(discover.column_values(rows, {n: list(d.kinds) for n, d in sets.items()}), "values")
            # the frames are held so that their identities stay theirs
            self._index = (state, rows, values, written(discover.overlap_matrix(values, None), "overlap"))
        return self._index[2], self._index[3]

    def candidates(self, min_coverage: float = discover.USABLE_COVERAGE) -> list[dict]:
        """The strongest key of each pair of sources, keys inside text included; a choice among columns."""
        sets = self.catalog.datasets
        values, overlap = self.overlap()
        found = [r.asDict() for r in discover.strongest_keys(self.pairs(min_coverage)[1]).collect()]
        linked = {frozenset((r["left_dataset"], r["right_dataset"])) for r in found}
        ids: dict[str, list[str]] = {}
        for r in discover.identifier_columns(values).orderBy("dataset", "column").collect():
            ids.setdefault(r.dataset, []).append(r.column)
        rows = self.visible()
        if all(frozenset((a, b)) in linked for a in sets for b in sets if a != b):
            return found
        hits = embedded.worth(embedded.search(rows, {n: d.text_columns for n, d in sets.items()}, {n: [c for c in d.kinds if c in ids.get(n, [])] for n, d in sets.items()})).collect()
        # a text column that equals the key in a quarter of its values is an ordinary join
        plain = {(r[f"{a}_dataset"], r[f"{a}_column"], r[f"{b}_dataset"], r[f"{b}_column"]): r[f"{a}_coverage"] for r in overlap.collect() for a, b in (("left", "right"), ("right", "left"))}
        order = {(n, c): i for n, d in sets.items() for i, c in enumerate(d.kinds)}
        best: dict[tuple[str, str], dict] = {}
        for hit in sorted((h.asDict() for h in hits), key=lambda h: (order[h["carrier"], h["text"]], order[h["key_dataset"], h["key"]])):
            pair = (hit["carrier"], hit["key_dataset"])
            if plain.get((hit["carrier"], hit["text"], hit["key_dataset"], hit["key"]), 0) < embedded.ALREADY_JOINED and hit["coverage"] > best.get(pair, {"coverage": -1})["coverage"]:
                best[pair] = hit
        for carrier in sets:
            for other in sets:
                hit = best.get((carrier, other))
                if hit is None or frozenset((carrier, other)) in linked:
                    continue
                view = embedded.publish(self.visible()[carrier], hit["text"], rows[other], hit["key"])
                self.views[carrier] = written(view, f"{carrier}-keys")
                found.append({"left_dataset": carrier, "left_column": view.columns[-1], "right_dataset": other, "right_column": hit["key"], "shared": hit["resolved"], "left_coverage": hit["coverage"], "right_coverage": hit["coverage"], "jaccard": hit["coverage"], "embedded_in": hit["text"], "ambiguous": hit["ambiguous"], "of_rows": hit["n_rows"]})
                linked.add(frozenset((carrier, other)))
        return found

    def _amounts_of(self, name: str) -> list[str]:
        d = self.catalog.datasets[name]
        texts = []
        if d.text_columns:
            texts = [r.column for r in amounts.numeric_text_ratios(d.rows, d.text_columns).where("usable").collect()]
        return [*d.number_columns, *[c for c in d.text_columns if c in texts], *(["signed_amount"] if "signed_amount" in self.views.get(name, d.rows).columns else [])]

    def run_auto(self, min_coverage: float = discover.USABLE_COVERAGE) -> dict:
        """One rule for each pair of sources that a shape and an amount speak for; the others are declined with a reason.

        ``min_coverage`` is the share of a key's values that the other side must
        have. The result names the keys found inside text, and what to do next.
        """
        views, results, declined = self.normalise(), [], []
        found = self.candidates(min_coverage)
        inside = [{"found": f"{c['right_dataset']}.{c['right_column']} inside {c['left_dataset']}.{c['embedded_in']}", "published_as": f"{c['left_dataset']}.{c['left_column']}", "resolved": c["shared"], "ambiguous_rows_dropped": c["ambiguous"], "of_rows": c["of_rows"]} for c in found if "embedded_in" in c]
        for c in found:
            ln, lk, rn, rk = (c[k] for k in ("left_dataset", "left_column", "right_dataset", "right_column"))
            rows = self.visible()
            left, right = rows[ln], rows[rn]
            shape = amounts.classify(left, lk, right, rk).first().shape
            if shape == "N:M":
                declined.append({"pair": (ln, rn), "reason": f"neither {ln}.{lk} nor {rn}.{rk} tells rows apart"})
                continue
            if shape == "N:1":
                ln, lk, rn, rk, left, right = rn, rk, ln, lk, right, left
            la, ra = self._amounts_of(ln), self._amounts_of(rn)
            best = amounts.best_row_amounts(amounts.row_probes(left, lk, la, right, rk, ra), la, ra) if shape == "1:1" and la and ra else None
            part = None
            if shape != "1:1":
                best, part = self._one_to_many(left, lk, la, right, rk, ra, [x for x in self.catalog.datasets[rn].kinds if x != rk])
                if best is None:
                    declined.append({"pair": (ln, rn), "reason": "no amounts agree across one to many"})
                    continue
            elif best is None and "embedded_in" in c:
                declined.append({"pair": (ln, rn), "reason": "a key inside text alone is no match without amounts"})
                continue
            a, b = (best.left, best.right) if best else (None, None)
            spec = f"{shape} {ln}.{lk}={rn}.{rk} {a}~{b} {best.strategy if best else 'row'}{' where {}={}'.format(*part) if part else ''}"
            sides, pair = ((ln, left, lk, a), (rn, right, rk, b)), f"{slug(ln)}__{slug(rn)}"
            if best and best.strategy == "aggregate":
                rule, members = f"auto_batch__{pair}", match.aggregate_members(*sides)
            elif part:
                column, value = part
                rule, members = f"auto_part__{pair}__{slug(column)}_{slug(value)}", match.row_level_members(*sides, where=F.col(column).cast("string") == value)
            else:
                rule, members = f"auto_exact__{pair}", match.row_level_members(*sides)
            done = self.ledger.propose(rule, members, spec, best.tolerance_minor if best else 0, check=self.checks)
            results.append(done | {"join": f"{ln}.{lk} = {rn}.{rk}", "shape": shape, "strategy": best.strategy if best else "row", "amounts": (a, b) if best else None, "tolerance_minor": best.tolerance_minor if best else 0})
        then = "look at what was declined first, then at the unmatched rows" if declined else "look at the unmatched rows of the coverage"
        return {"rules_run": len(results), "groups_proposed": sum(r["proposed"] for r in results), "results": results, "normalised_views": views, "embedded_keys": inside, "declined": declined, "coverage": self.coverage(), "next": then}

    @staticmethod
    def _one_to_many(one: DataFrame, one_key: str, one_amounts: list[str], many: DataFrame, many_key: str, many_amounts: list[str], columns: list[str]) -> tuple[amounts.Amounts | None, tuple[str, str] | None]:
        """The sum of the many rows or one class of them, whichever explains more rows; then by agreement."""
        if not one_amounts or not many_amounts:
            return None, None
        sums = amounts.best_aggregate_amounts(amounts.aggregate_probes(one, one_key, one_amounts, many, many_key, many_amounts), one_amounts, many_amounts)
        classes = [r.column for r in amounts.partition_values(many, columns).select("column").distinct().collect() if r.column not in many_amounts]
        part = amounts.best_partitioned_amounts(amounts.partitioned_probes(one, one_key, one_amounts, many, many_key, many_amounts, sorted(classes)), one_amounts, many_amounts) if classes else None
        if part and (sums is None or (part[0].exact, part[0].agreement) > (round(sums.agreement * sums.joined), sums.agreement)):
            return part[0], part[1:]
        return sums, None

    def run_rule(self, rule: str, members: DataFrame | str, tolerance_minor: int = 0, author: str = "agent", spec: str | None = None, tier: int | None = None, description: str = "") -> dict:
        """A rule of one's own: SQL text, or a DataFrame, that gives (group_key, dataset, row_id[, role, amount_minor]). Tier and description stay with the event that proposes each group."""
        text = members if isinstance(members, str) else spec or rule
        if isinstance(members, str):
            members = analysed(self.spark, members, self.tables())
        if missing := {"group_key", "dataset", "row_id"} - set(members.columns):
            raise ValueError(f"the rule's result lacks {sorted(missing)}")
        for c, t in (("role", "string"), ("amount_minor", "bigint")):
            if c not in members.columns:
                members = members.withColumn(c, F.lit(None).cast(t))
        unknown = members.join(self.spark.createDataFrame([(n,) for n in self.catalog.datasets], "dataset string"), "dataset", "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"no source is called {unknown[0].dataset}")
        shaped = members.select(F.col("group_key").cast("string"), "dataset", F.col("row_id").cast("bigint"), "role", F.col("amount_minor").cast("bigint"))
        note = json.dumps({k: v for k, v in (("tier", tier), ("description", description)) if v})
        return self.ledger.propose(rule, written(shaped, "rule"), text, tolerance_minor, author, self.checks, note)

    def run_reconciliation(self, request: dict) -> dict:
        known = {"mode", "rule", "sql", "description", "tolerance_minor", "tier", "spine", "min_coverage"}
        if extra := set(request) - known:
            raise ValueError(f"unknown keys {sorted(extra)}; known are {sorted(known)}")
        if "spine" in request:
            self.spine_declared = request["spine"]
        if request.get("mode", "auto") == "auto":
            return self.run_auto(request.get("min_coverage", discover.USABLE_COVERAGE))
        return self.run_rule(request["rule"], request["sql"], request.get("tolerance_minor", 0), tier=request.get("tier"), description=request.get("description", ""))

    # verification

    def checks(self, props: DataFrame, members: DataFrame) -> DataFrame:
        """Verification of proposals against all sources and all accepted claims, as one job."""
        sources = self.sources()
        currency = {n: verify.currency_column(s) for n, s in sources.items()}
        plain = {n: self.views.get(n, s) for n, s in sources.items()}
        pop = [tuple(r) for r in verify.population_columns(props, {n: s.drop("dup_of", "dup_kind") for n, s in plain.items()}).collect()]
        marks = self.marks()
        # what is usual for a rule follows from all its groups, not from those that are asked about
        peers = self.ledger.table("proposal").join(props.select("rule").distinct(), "rule", "left_semi")
        recorded = self.ledger.table("member")
        spans = timing.group_spans(self.instants(peers, recorded))
        return verify.verify(props, members, plain, {n: c for n, c in currency.items() if c}, pop, timing.timing(spans), self.ledger.status(), recorded, marks)

    def marks(self) -> DataFrame:
        """(dataset, row_id, dup_of) of every source."""
        return reduce(DataFrame.unionByName, [d.rows.select(F.lit(n).alias("dataset"), "row_id", "dup_of") for n, d in self.catalog.datasets.items()])

    def instants(self, props: DataFrame, members: DataFrame) -> DataFrame:
        """(rule, group_key, instant_s) of every ISO-shaped cell of every member row."""
        parts = []
        for n, d in self.catalog.datasets.items():
            cells = [(instant_micros(F.col(c).cast("string")) / 1e6) for c in d.kinds]
            if cells:
                parts.append(d.rows.select(F.lit(n).alias("dataset"), "row_id", F.filter(F.array(*cells), lambda x: x.isNotNull()).alias("instants")))
        if not parts:
            return self.spark.createDataFrame([], "rule string, group_key string, instant_s double")
        own = members.join(props.select("proposal_id", "rule"), "proposal_id")
        return own.join(reduce(DataFrame.unionByName, parts), ["dataset", "row_id"]).select("rule", "group_key", F.explode("instants").alias("instant_s"))

    def sweep(self, status: str | None = None) -> dict:
        """Verify proposals again, those of one status if named: {scope, verified, passed, failed, failures}, the last a DataFrame (proposal_id, rule, group_key, failed)."""
        asked = self.ledger.status()
        asked = asked if status is None else asked.where(F.col("status") == status)
        self.ledger.verify(self.checks, asked.drop("status"))
        last = self.ledger.verified().select("proposal_id", "failed", F.col("status").alias("checked"))
        seen = asked.select("proposal_id", "rule", "group_key").join(last, "proposal_id")
        n = seen.agg(F.count("*").alias("n"), F.count_if(F.col("checked") == "pass").alias("passed")).first()
        return {"scope": status or "all", "verified": n.n, "passed": n.passed, "failed": n.n - n.passed, "failures": seen.where("checked <> 'pass'").select("proposal_id", "rule", "group_key", "failed")}

    # what came of it

    def coverage(self) -> DataFrame:
        return report.coverage_by_dataset({n: d.rows for n, d in self.catalog.datasets.items()}, self.ledger.table("member"), self.ledger.status())

    def get_exceptions(self, kind: str = "all", limit: int = 50, dataset: str | None = None) -> DataFrame:
        """(kind, rule, group_key, detail) of what needs a person; of one source only where ``dataset`` names it."""
        status, last, members = self.ledger.status(), self.ledger.verified(), self.ledger.table("member")
        if dataset is not None:
            status = status.join(members.where(F.col("dataset") == dataset).select("proposal_id"), "proposal_id", "left_semi")
        kinds = status.where(F.col("confidence").isin("unbalanced", "ambiguous")).select(F.col("confidence").alias("kind"), "rule", "group_key", F.col("balance_minor").cast("string").alias("detail"))
        failed = last.where("status = 'fail'").join(status.select("proposal_id", "rule", "group_key"), "proposal_id").select(F.lit("verification_failed").alias("kind"), "rule", "group_key", F.array_join("failed", ",").alias("detail"))
        out = kinds.unionByName(failed)
        held = members.join(self.ledger.status().where("status <> 'rejected'").select("proposal_id"), "proposal_id", "left_semi")
        for n, d in self.catalog.datasets.items():
            if dataset in (None, n):
                rest = match.unmatched(d.rows, n, held)
                copies = d.rows.where("dup_kind = 'exact'").agg(F.count("*").alias("n")).where("n > 0")
                out = out.unionByName(rest.select(F.lit("unmatched").alias("kind"), F.lit(n).alias("rule"), F.col("row_id").cast("string").alias("group_key"), F.lit("").alias("detail")))
                out = out.unionByName(copies.select(F.lit("duplicated_rows").alias("kind"), F.lit(n).alias("rule"), F.lit("").alias("group_key"), F.col("n").cast("string").alias("detail")))
        return (out if kind == "all" else out.where(F.col("kind") == kind)).orderBy("kind", "rule", "group_key").limit(limit)

    def proposal(self, proposal_id: int) -> dict[str, DataFrame]:
        """A proposal with its members, events, last verification and, source by source, the rows it stands for."""
        found = self.ledger.detail(proposal_id, self.marks())
        own = found["members"]
        rows = {n: d.rows.join(own.where(F.col("dataset") == n).select("row_id"), "row_id", "left_semi") for n, d in self.catalog.datasets.items()}
        return found | {f"rows:{n}": r for n, r in rows.items()}

    def resolve_spine(self) -> tuple[str | None, str, list[tuple[str, str]]]:
        """(spine, why, precedence edges)."""
        names, members = list(self.catalog.datasets), self.ledger.table("member")
        edges = []
        for r in spine.adjacency(members).where("a < b").collect():
            left, right = self.catalog.datasets[r.a], self.catalog.datasets[r.b]
            if left.date_columns and right.date_columns:
                pairs = spine.member_pairs(members, r.a, r.b)
                edge = spine.precedence_edge(spine.precedence(pairs, left.rows, left.date_columns, right.rows, right.date_columns), r.a, r.b)
                edges += [edge] if edge else []
        chosen, why = spine.infer_spine(names, edges, self.medians(), {} if edges else self.containment(), self.spine_declared)
        return chosen, why, edges

    def medians(self) -> dict[str, str]:
        return {n: spine.upper_median(d.rows, d.date_columns[0]).first().value for n, d in self.catalog.datasets.items() if d.date_columns}

    def containment(self) -> dict[tuple[str, str], float]:
        """The largest share of a column's values that a column of another source holds, for each pair of sources."""
        out: dict[tuple[str, str], float] = {}
        for r in self.pairs()[1].collect():
            for a, b, share in ((r.left_dataset, r.right_dataset, r.left_coverage), (r.right_dataset, r.left_dataset, r.right_coverage)):
                out[a, b] = max(out.get((a, b), 0.0), share)
        return out

    def label_column(self, name: str) -> str:
        """The column that names a transaction across sources: shared with others and different from row to row, so the product decides."""
        d = self.catalog.datasets[name]
        shared: dict[str, float] = {}
        for r in self.pairs()[1].collect():
            for side, share in (("left", r.left_coverage), ("right", r.right_coverage)):
                if r[f"{side}_dataset"] == name:
                    shared[r[f"{side}_column"]] = max(shared.get(r[f"{side}_column"], 0.0), share)
        if not shared:
            return (d.text_columns or list(d.kinds))[0]
        stats = d.rows.agg(*[F.try_divide(F.count_distinct(F.col(c)), F.count(c)).alias(c) for c in shared]).first()
        order = list(d.kinds)
        return max(shared, key=lambda c: (shared[c] * (stats[c] or 0.0), -order.index(c) if c in order else 0))

    def chains(self, label: str | None = None) -> dict[str, DataFrame]:
        """States, steps and reasons of every chain, and what is left over."""
        chosen, _, edges = self.resolve_spine()
        status, members = self.ledger.status(), self.ledger.table("member")
        d = self.catalog.datasets[chosen]
        label = label or self.label_column(chosen)
        stages = [chosen, *[x for x in spine.stage_order(list(self.catalog.datasets), edges, {} if edges else self.medians()) if x != chosen]]
        legs = written(chains.reached(chains.labelled_members(d.rows, chosen, label, members, status), members, status), "legs")
        steps = written(chains.hops(legs, members, status, stages), "steps")
        return {
            "states": chains.ordered(chains.chain_states(d.rows, label, legs, status)),
            "hops": steps,
            "reasons": chains.break_reasons(steps, status),
            "holds": chains.hold_reasons(legs, status, self.ledger.verified()),
            "leftovers": chains.leftovers({n: x.rows for n, x in self.catalog.datasets.items()}, chosen, members, status),
        }

    def trace_record(self, value: str, max_hops: int = 2) -> DataFrame:
        picked: dict[str, list[str]] = {}
        for r in discover.identifier_columns(self.overlap()[0]).collect():
            picked.setdefault(r.dataset, []).append(r.column)
        rows = {n: df for n, df in self.visible().items() if n in picked}
        return discover.trace(profile.long_values(rows, picked), value, max_hops)

    def get_transaction_chain(self, value: str) -> dict[str, DataFrame]:
        """Rows that a value leads to, the proposals that hold them and those proposals' events."""
        hits = written(self.trace_record(value), "trace")
        ids = self.ledger.table("member").join(hits, ["dataset", "row_id"], "left_semi").select("proposal_id").distinct()
        return {"hits": hits, "proposals": self.ledger.status().join(ids, "proposal_id", "left_semi"), "events": self.ledger.table("event").join(ids, "proposal_id", "left_semi").orderBy("seq")}

    def close_report(self) -> dict:
        """The parts of a close: coverage, decisions, exceptions, value, checksum, and what limits them."""
        status, members = self.ledger.status(), self.ledger.table("member")
        sources = {n: d.rows for n, d in self.catalog.datasets.items()}
        held = members.join(status.where("status <> 'rejected'").select("proposal_id"), "proposal_id", "left_semi")
        rest = sum(match.unmatched(d, n, held).count() for n, d in sources.items())
        currency = None
        for n, s in self.sources().items():
            c = verify.currency_column(s)
            own = s.select(F.lit(n).alias("dataset"), "row_id", (F.col(c) if c else F.lit(None).cast("string")).alias("currency"))
            currency = own if currency is None else currency.unionByName(own)
        limits = []
        duplicates, values, dates = [], [], []
        picked = {n: s.join(members.where(F.col("dataset") == n).select("row_id").distinct(), "row_id", "left_semi") for n, s in self.sources().items()}
        votes = {r.dataset: r.column for r in report.amount_vote(members, verify.source_cells(picked)).collect()}
        for n, d in self.catalog.datasets.items():
            marked = duplicate_summary(d.rows).select(F.lit(n).alias("dataset"), "dup_kind", "n", F.lit(not d.exclude_duplicates).alias("counted"))
            duplicates.append(marked)
            limits += [f"{n}: {r.n} {r.dup_kind} copies {'count as rows of their own' if r.counted else 'are left out'}" for r in marked.orderBy("dup_kind").collect()]
            own = verify.currency_column(self.sources()[n])
            # amounts of several currencies have no sum
            if n in votes and (own is None or d.rows.select(F.upper(F.trim(own))).distinct().limit(2).count() == 1):
                values.append(report.dataset_value(d.rows, n, votes[n], members, status))
            if d.date_columns:
                dates.append(report.period(d.rows, d.date_columns))
        if rest:
            limits.append(f"{rest} rows are in no proposal")
        ends = reduce(DataFrame.unionByName, dates).agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest")) if dates else None
        return {
            "sources": [{"dataset": n, "rows": d.rows.count(), "columns": len(d.kinds)} for n, d in self.catalog.datasets.items()],
            "period": ends,
            "dataset_value": reduce(DataFrame.unionByName, values) if values else None,
            "duplicates": reduce(DataFrame.unionByName, duplicates),
            "counters": report.decision_counters(self.ledger.table("event")),
            "coverage": report.coverage_by_dataset(sources, members, status),
            "edges": report.coverage_by_edge(members, status),
            "decisions": report.decision_ledger(self.ledger.table("event")),
            "sides": report.coverage_sides(sources, members, status),
            "summary": report.status_summary(status),
            "exceptions": report.exceptions_by_cause(self.ledger.verified(), status, rest),
            "value": report.value_by_currency(members, status, currency),
            "checksum": report.checksum(report.decision_lines(status, members)),
            "rules": self.ledger.list_rules(),
            "limits": limits,
        }
