"""Runs of many steps. After each step the rates go to the shared folder, which cuts the lineage and survives lost executors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeline.functions.rng import INITIAL_DOMAIN, checked_seed, derived_seed, episode_seed
from sporeline.operators import leaps as L
from sporeline.operators.models import Model
from sporeline.plans import steps
from sporeline.sources.graphs import INTEGERS, Graph
from sporeline.sources.storage import dropped, stored


@dataclass(frozen=True)
class Config:
    """How steps are sized. Markovian models use theta, max_prob, tau_min and tau_max; renewal ones epsilon and tau_max."""

    epsilon: float = 0.03
    tau_max: float | None = None
    theta: float = 0.01
    max_prob: float = 0.1
    tau_min: float = 1e-6

    def __post_init__(self):
        for name in ("epsilon", "theta", "max_prob", "tau_min"):
            x = getattr(self, name)
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x <= 0:
                raise ValueError(f"{name} is a positive finite number")
        if self.tau_max is not None and not (math.isfinite(self.tau_max) and self.tau_max > 0):
            raise ValueError("tau_max is a positive finite number")
        if self.theta > 1 or self.max_prob >= 1:
            raise ValueError("theta is 1 at most, max_prob less than 1")

    def control(self, model: Model) -> dict:
        if model.markovian:
            return {"theta": self.theta, "max_prob": self.max_prob, "tau_min": self.tau_min, "tau_max": self.tau_max or 1.0}
        return {"epsilon": self.epsilon, "tau_max": self.tau_max or 0.1}


@dataclass
class Simulator:
    """A run of model on graph. All that changes is replaced as a whole after a step has been found valid."""

    graph: Graph
    model: Model
    seed: int = 0
    config: Config = field(default_factory=Config)
    replicas: int | None = None

    def __post_init__(self):
        checked_seed(self.seed)
        if self.replicas is not None and (isinstance(self.replicas, bool) or not isinstance(self.replicas, int) or self.replicas < 1):
            raise ValueError("replicas is an integer, 1 at least")
        self.base_seed = self.seed
        self.reset()

    @property
    def keys(self) -> tuple[str, ...]:
        return ("node",) if self.replicas is None else ("node", "replica")

    @property
    def _lane(self):
        return F.col("node") if self.replicas is None else F.col("node") * self.replicas + F.col("replica")

    def reset(self, episode: int | None = None) -> None:
        """Everyone susceptible at time 0. Episode 0 repeats the first run; others have streams of their own."""
        self.seed = episode_seed(self.base_seed, episode)
        self.times = [0.0] * (self.replicas or 1)
        self.steps, self.events, self._seeded = 0, 0, set()
        self.states = self._everyone(self.model.susceptible)
        self._kept: DataFrame | None = None

    def reseed(self, seed: int) -> None:
        """Another stream from here on; states and times stay."""
        checked_seed(seed)
        self.seed = self.base_seed = seed

    def _everyone(self, state: int) -> DataFrame:
        rows = self.graph.nodes.select("node")
        if self.replicas is not None:
            rows = rows.select("node", F.explode(F.sequence(F.lit(0), F.lit(self.replicas - 1))).alias("replica"))
        return rows.select(*self.keys, F.lit(state).alias("state"), F.lit(0.0).alias("age"))

    def seed_infection(self, k: int | list[int], state: int | None = None) -> Simulator:
        """Put k random nodes (of each replica; a list has one k for each) into state, by default the model's first one after susceptible."""
        state = self.model.entry if state is None else state
        if isinstance(state, bool) or not 0 <= state < len(self.model.states):
            raise ValueError("no such state")
        if self.steps or state in self._seeded:
            raise RuntimeError("a state is seeded once, before the first step")
        ks = k if isinstance(k, list) else [k] * (self.replicas or 1)
        if len(ks) != (self.replicas or 1) or any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for x in ks):
            raise ValueError("k is a count, or a list with one for each replica")
        seed = derived_seed(self.seed, INITIAL_DOMAIN + state)
        if self.replicas is None:
            chosen = L.sampled_nodes(self.graph.nodes, ks[0], seed)
        else:
            counts = self.graph.nodes.sparkSession.createDataFrame(list(enumerate(ks)), "replica int, k long")
            chosen = L.sampled_by_replica(self.graph.nodes, counts, self.replicas, seed)
        chosen = chosen.select(*self.keys, F.lit(True).alias("_chosen"))
        self.states = self.states.join(chosen, list(self.keys), "left").select(*self.keys, F.when(F.col("_chosen"), F.lit(state)).otherwise(F.col("state")).alias("state"), "age")
        self._seeded.add(state)
        return self

    def set_states(self, states: DataFrame) -> Simulator:
        """Install states(node[, replica], state[, age]) after they are found to cover every node once, with known states and finite ages."""
        if self.model.markovian and "age" in states.columns:
            raise ValueError("a memoryless model has no ages")
        if not isinstance(states.schema["state"].dataType, INTEGERS):
            raise TypeError("state must be an integer column")
        if self.replicas is not None and "replica" not in states.columns:  # one initial condition for all
            states = states.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(self.replicas - 1))))
        age = F.col("age").cast("double") if "age" in states.columns else F.lit(0.0)
        new = states.select(*self.keys, F.col("state").cast("long").alias("state"), age.alias("age"))
        bad = (F.col("state").isNull() | (F.col("state") < 0) | (F.col("state") >= len(self.model.states)) | F.col("age").isNull() | F.isnan("age") | (F.col("age") < 0) | (F.col("age") == float("inf"))).cast("long")
        x = new.agg(F.count("*").alias("n"), F.count_distinct(*self.keys).alias("each"), F.sum(bad).alias("bad")).first()
        known = new.join(self._everyone(0).select(*self.keys), list(self.keys), "left_semi").count()
        n = self.graph.nodes.count() * (self.replicas or 1)
        if x.bad or x.n != n or x.each != n or known != n:
            raise ValueError("states must have each node once, a known state and a finite age, 0 at least")
        self.states = new.select(*self.keys, F.col("state").cast("int").alias("state"), "age")
        return self

    def step(self) -> list[float]:
        """One step; the elapsed time of each replica. If any rate isn't finite and 0 at least, it raises and nothing changes."""
        if self.replicas is None:
            rated = steps.rates(self.graph, self.states, self.model)
        else:
            rated = steps.ensemble_rates(self.graph, self.states, self.model, self.replicas)
        rated = stored(rated.select(*self.keys, "state", "age", "rate"), "rates")
        by = self.keys[1:]
        found = steps.step_size(rated, self.model, self.config.control(self.model), by).collect()  # a row for each replica
        taus = {x.replica if by else 0: x.tau for x in found}
        if any(x.invalid for x in found) or any(t is None or not math.isfinite(t) or t <= 0 for t in taus.values()):
            dropped(rated)
            raise FloatingPointError("a rate isn't a finite number of 0 at least, or a step has no length")
        if by:
            sizes = rated.sparkSession.createDataFrame([(r, float(t)) for r, t in taus.items()], T.StructType([T.StructField("replica", T.IntegerType()), T.StructField("tau", T.DoubleType())]))
            held = rated.join(F.broadcast(sizes), "replica")
        else:
            held = rated.withColumn("tau", F.lit(float(taus[0])))
        after = L.leap(held, self.model, self._lane, self.seed, self.steps + 1)
        self.events += after.agg(F.sum(F.col("event").cast("long"))).first()[0] or 0
        if self._kept is not None:
            dropped(self._kept)
        self.states, self._kept = after.select(*self.keys, "state", "age"), rated
        self.steps += 1
        elapsed = [float(taus[r]) for r in range(self.replicas or 1)]
        self.times = [t + d for t, d in zip(self.times, elapsed, strict=True)]
        return elapsed

    def counts(self) -> list[tuple[int, ...]]:
        """How many nodes are in each state, for each replica."""
        held = self.states if self.replicas is not None else self.states.withColumn("replica", F.lit(0))
        names = self.model.states
        return [tuple(x[n] for n in names) for x in L.replica_counts(held, names, self.model.inducers).orderBy("replica").collect()]

    def num_infected(self) -> list[int]:
        return [sum(c[q] for q in self.model.inducers) for c in self.counts()]

    def run(self, until: float, record_every: float = 1.0) -> DataFrame:
        """A table (t, counts of states): the start, whenever record_every has passed since the last record, and the end.

        The run stops with the first step that reaches until. Without replicas only, as replicas have times of their own.
        """
        if self.replicas is not None:
            raise ValueError("replicas have different times; use step()")
        if not math.isfinite(until) or until < self.times[0] or not (math.isfinite(record_every) and record_every > 0):
            raise ValueError("until is a finite time from now on, record_every positive")
        rows = [(self.times[0], *self.counts()[0])]
        due = self.times[0] + record_every
        while self.times[0] < until:
            before = self.times[0]
            self.step()
            if self.times[0] <= before:
                raise RuntimeError("time didn't advance")
            if self.times[0] >= due:
                rows.append((self.times[0], *self.counts()[0]))
                due = self.times[0] + record_every
        if rows[-1][0] != self.times[0]:
            rows.append((self.times[0], *self.counts()[0]))
        return self.graph.nodes.sparkSession.createDataFrame(rows, "t double, " + ", ".join(f"{s} long" for s in self.model.states))

    def episode(self, number: int) -> Simulator:
        """A new simulator for another episode of the same seed."""
        other = replace(self, seed=self.base_seed)
        other.reset(number)
        return other
