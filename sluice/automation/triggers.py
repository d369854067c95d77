"""Triggers: an event type and table, a condition and an action. The facade's statements fire them."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from sluice.errors import DuplicateName, NotRegistered
from sluice.udf import Registry, truthy

log = logging.getLogger(__name__)


class EventType(Enum):
    BEFORE_INSERT = "before insert"
    AFTER_INSERT = "after insert"
    BEFORE_UPDATE = "before update"
    AFTER_UPDATE = "after update"
    BEFORE_DELETE = "before delete"
    AFTER_DELETE = "after delete"
    SCHEDULED = "scheduled"


@dataclass(frozen=True)
class Event:
    """``data`` holds a row's values in column order, or a statement's number of rows."""

    type: EventType
    table: str
    data: dict[str, Any] = field(default_factory=dict)
    timestamp: float = field(default_factory=time.time)


@dataclass
class Trigger:
    """Condition: None (always), a function's name, or a callable on the event. Action: a name or a callable."""

    name: str
    type: EventType
    table: str
    action: str | Callable[[Event], Any]
    condition: str | Callable[[Event], Any] | None = None
    for_each_row: bool = False

    def matches(self, event: Event) -> bool:
        return event.type == self.type and event.table.lower() == self.table.lower()

    def holds(self, event: Event, functions: Registry) -> bool:
        if self.condition is None:
            return True
        try:
            return truthy(functions.call(self.condition, *event.data.values()) if isinstance(self.condition, str) else self.condition(event))
        except Exception:
            log.warning("condition of trigger %s failed", self.name, exc_info=True)
            return False

    def run(self, event: Event, functions: Registry) -> Any:
        return functions.call(self.action, *event.data.values()) if isinstance(self.action, str) else self.action(event)


class Triggers:
    def __init__(self, functions: Registry):
        self.functions, self._all = functions, {}

    def register(self, trigger: Trigger) -> None:
        if trigger.name in self._all:
            raise DuplicateName(trigger.name)
        self._all[trigger.name] = trigger

    def unregister(self, name: str) -> None:
        if self._all.pop(name, None) is None:
            raise NotRegistered(name)

    def list(self) -> list[str]:
        return sorted(self._all)

    def wants(self, kind: EventType, table: str, rows: bool) -> bool:
        return any(t.matches(Event(kind, table)) and t.for_each_row == rows for t in self._all.values())

    def fire(self, event: Event, rows: bool | None = None) -> list[str]:
        """Runs the matching triggers; one that fails is logged and the others go on. Returns the names that ran."""
        fired = []
        for t in list(self._all.values()):
            if t.matches(event) and (rows is None or t.for_each_row == rows) and t.holds(event, self.functions):
                try:
                    t.run(event, self.functions)
                    fired.append(t.name)
                except Exception:
                    log.warning("trigger %s failed", t.name, exc_info=True)
        return fired
