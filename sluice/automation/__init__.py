"""Triggers on table changes, and scheduled jobs; both run on the driver."""

from sluice.automation.schedule import Cron, Daily, Interval, Job, Once, Scheduler, Weekly
from sluice.automation.triggers import Event, EventType, Trigger, Triggers

__all__ = ["Cron", "Daily", "Event", "EventType", "Interval", "Job", "Once", "Scheduler", "Trigger", "Triggers", "Weekly"]
