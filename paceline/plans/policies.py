"""Scaling policies as data, and the settings of an evaluation."""

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.sizes import CoreLimits, JobSize, resize_cores
from paceline.functions.times import MINUTE_MS
from paceline.operators.arrival import CHUNK
from paceline.operators.fold import MAX_ATTEMPTS

# Statuses of an action.
STATUSES = ("ENQUEUED", "ISSUED", "COMPLETE", "DISCARDED")


def unbounded(usage: Column) -> Column:
    """Usage as it was measured."""
    return usage


@dataclass(frozen=True)
class Policy:
    """A rule over the average of a trailing window.

    ``required(usage, cores)`` says whether to act, ``target(usage)`` gives the cores per
    container, ``bound`` may change the usage before it is turned into a target.
    """

    name: str
    action_type: str
    window_ms: int
    required: Callable[[Column, Column], Column]
    target: Callable[[Column], Column]
    allow: str = ".*"
    bound: Callable[[Column], Column] = unbounded


def cpu_scale_up(
    *, window_ms: int, trigger: float, margin: float, allow: str = ".*", **options
) -> Policy:
    return Policy(
        name="cpu_scale_up",
        action_type="JOB_VCORE_SCALEUP",
        window_ms=window_ms,
        required=lambda usage, cores: usage >= cores * trigger,
        target=lambda usage: F.ceil(usage * (1 + margin)),
        allow=allow,
        **options,
    )


def cpu_scale_down(
    *, window_ms: int, trigger: float, margin: float, allow: str = ".*", **options
) -> Policy:
    return Policy(
        name="cpu_scale_down",
        action_type="JOB_VCORE_SCALEDOWN",
        window_ms=window_ms,
        required=lambda usage, cores: usage <= cores * trigger,
        target=lambda usage: F.ceil(usage * (1 - margin)),
        allow=allow,
        **options,
    )


def default_policies() -> tuple[Policy, ...]:
    return (
        cpu_scale_up(window_ms=120_000, trigger=1.1, margin=0.0),
        cpu_scale_down(window_ms=120_000, trigger=0.5, margin=0.0),
    )


Resizer = Callable[[Column, Column, CoreLimits], Column]


@dataclass(frozen=True)
class Settings:
    """Parameters of state keeping and evaluation. Policies are listed by priority."""

    policies: tuple[Policy, ...] = field(default_factory=default_policies)
    limits: CoreLimits = CoreLimits()
    resizer: Resizer = resize_cores
    max_staleness_ms: int = 200_000
    deny: str = ""
    start_delay_ms: int = 30_000
    granularity_ms: int = MINUTE_MS
    tolerance_ms: int = 0
    default_size: JobSize = JobSize()
    max_attempts: int = MAX_ATTEMPTS
    max_actions: int = 2_000
    active_statuses: tuple[str, ...] = STATUSES
    chunk: int = CHUNK

    @property
    def retention_ms(self) -> int:
        return max(p.window_ms for p in self.policies)

    def only(self, name: str) -> "Settings":
        """The same settings with a single policy."""
        return replace(self, policies=tuple(p for p in self.policies if p.name == name))


def settings_from_properties(values: Mapping[str, str], **overrides) -> Settings:
    """Settings from a flat property map, as read from a ``key=value`` file."""
    # The property names below.

    def cpu(make: Callable[..., Policy], part: str) -> Policy:
        return make(
            window_ms=int(values[f"asc.policy.{part}.window.ms"]),
            trigger=float(values[f"asc.policy.{part}.trigger.factor"]),
            margin=float(values[f"asc.policy.{part}.margin.fraction"]),
            allow=values.get(f"asc.policy.{part}.whitelist", ".*"),
        )

    return Settings(
        policies=(cpu(cpu_scale_up, "cpuscaleup"), cpu(cpu_scale_down, "cpuscaledown")),
        limits=CoreLimits(
            per_container=int(values["asc.policy.stateless.maxnumvcorespercontainer"]),
            per_job=int(values["asc.policy.stateless.maxnumvcoresperjob"]),
            container_mb=int(values["asc.policy.stateless.maxcontainermb"]),
            job_mb=int(values["asc.policy.stateless.maxjobmemorymb"]),
        ),
        max_staleness_ms=int(values["asc.policy.max-staleness.ms"]),
        deny=values.get("asc.policy.blacklist", ""),
        **overrides,
    )
