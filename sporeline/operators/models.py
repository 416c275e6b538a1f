"""Compartment models: states, and Columns for rates, transitions and infectivity."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sporeline.functions.hazards import hazard


@dataclass(frozen=True)
class Model:
    """rate and infectivity take the columns state, age and pressure (infectivity: state and age); next_state names each state's successor.

    A custom model gives its own functions of Columns; a function of numpy arrays can be wrapped as a pandas UDF.
    """

    states: tuple[str, ...]
    inducers: tuple[int, ...]
    next_state: tuple[int, ...]
    rate: Callable[[Column, Column, Column], Column]
    markovian: bool
    susceptible: int = 0
    entry: int = 1
    infectivity: Callable[[Column, Column], Column] | None = None

    def __post_init__(self):
        n = len(self.states)
        if not self.inducers or len(set(self.inducers)) < len(self.inducers) or any(not 0 <= q < n for q in self.inducers):
            raise ValueError("inducers are distinct states, one at least")
        if len(self.next_state) != n or any(not 0 <= q < n for q in self.next_state):
            raise ValueError("every state has a successor (an absorbing one itself)")
        if not isinstance(self.markovian, bool):
            raise TypeError("markovian is a bool")

    def transition(self, state: Column) -> Column:
        """Each state's successor, from the state before the step: one hop at most."""
        out = state
        for q, to in enumerate(self.next_state):
            if to != q:
                out = F.when(state == q, F.lit(to)).otherwise(out)
        return out

    @property
    def absorbing(self) -> list[int]:
        return [q for q, to in enumerate(self.next_state) if q == to]


def _positive(**values: float) -> None:
    for name, x in values.items():
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0:
            raise ValueError(f"{name} is a finite number, 0 at least")


def sis(beta: float, delta: float) -> Model:
    _positive(beta=beta, delta=delta)
    return Model(("S", "I"), (1,), (1, 0), lambda state, age, pressure: F.when(state == 0, beta * pressure).otherwise(F.lit(float(delta))), True)


def sir(beta: float, gamma: float) -> Model:
    _positive(beta=beta, gamma=gamma)
    return Model(("S", "I", "R"), (1,), (1, 2, 2), lambda state, age, pressure: F.when(state == 0, beta * pressure).when(state == 1, F.lit(float(gamma))).otherwise(F.lit(0.0)), True)


def seir(beta: float, ei_mean: float, ei_median: float, ir_mean: float, ir_median: float, age_dependent: bool = False) -> Model:
    """Log-normal dwell times in E and I. With age_dependent, an infectious node sends beta times its own hazard, else beta."""
    _positive(beta=beta)
    leave_e, leave_i = hazard("lognormal", mean=ei_mean, median=ei_median), hazard("lognormal", mean=ir_mean, median=ir_median)

    def rate(state: Column, age: Column, pressure: Column) -> Column:
        catch = pressure if age_dependent else beta * pressure  # what arrives along edges has beta in it already
        return F.when(state == 0, catch).when(state == 1, leave_e(age, pressure)).when(state == 2, leave_i(age, pressure)).otherwise(F.lit(0.0))

    def infectivity(state: Column, age: Column) -> Column:
        return F.when(state == 2, beta * leave_i(age, F.lit(0.0)) if age_dependent else F.lit(float(beta))).otherwise(F.lit(0.0))

    return Model(("S", "E", "I", "R"), (2,), (1, 2, 3, 3), rate, False, infectivity=infectivity if age_dependent else None)
