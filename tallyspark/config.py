"""Parameters of task analytics: labels, keyword lists, overdue policies. Nothing here reads a clock."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Statuses, priorities and keywords of the task tracker and the mailbox.
NOT_STARTED, DONE = "Not started", "Done"
COUNTED_STATUSES = ("Not started", "In progress", "In review", "Waiting", "Rejected – actioned", "Rejected – hold", "Done", "Overdue")
PRIORITIES = ("High", "Medium", "Low")
TAG_KEYWORDS = ("marketing", "growth", "client", "urgent")
DOCUMENT_NOTE = ("Task Completed", "Document created and logged: ")
TAG_TRIGGERS = (
    ("course", ("module", "lesson", "kartra", "coaching", "framework")),
    ("client", ("email", "consult", "booking")),
    ("tech", ("zapier", "automation", "python", "api")),
)


@dataclass(frozen=True)
class OverduePolicy:
    """When a task is overdue.

    ``grain``: ``date`` (due day before the as-of day), ``midnight`` (due day's midnight before the
    as-of time, so a task due today is overdue) or ``timestamp`` (full due time before it).
    ``exempt``: statuses that never are; ``default_status`` stands for a missing one.
    """

    name: str
    grain: str
    exempt: tuple[str, ...]
    default_status: str = ""


OVERDUE = {
    p.name: p
    for p in (
        OverduePolicy("metrics", "date", ("Done", "Rejected – hold"), "Unknown"),
        OverduePolicy("digest", "date", ("Done", "Archived")),
        OverduePolicy("guardian", "midnight", ("Done", "Archived")),
        OverduePolicy("manager", "timestamp", ("Done",)),
    )
}
DEFAULT_POLICY = OVERDUE["digest"]


@dataclass(frozen=True)
class Settings:
    """Connector settings; the values come from the environment and are never written anywhere."""

    sender: str = ""
    recipient: str = ""
    channel: str = ""
    database: str = ""
    waiting_label: str = "Waiting"
    agent: str = "default"
    routes: tuple[tuple[str, str], ...] = (("approve", "owner"), ("automation", "swarm"))
    extra: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        return cls(sender=env.get("SENDER_EMAIL", ""), recipient=env.get("RECIPIENT_EMAIL", ""), channel=env.get("CHAT_CHANNEL", ""), database=env.get("TASK_DATABASE", ""), waiting_label=env.get("WAITING_LABEL", "Waiting"))
