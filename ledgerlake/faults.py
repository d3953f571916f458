"""Crashes and faults that tests arm by name; each happens once.

``Store(..., hook=Faults(...))`` takes them: a crash ends the process, a fault raises.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from ledgerlake import errors as E

#: Name -> place in the store. The names and the exit code are fixed values.
CRASHES = {
    "wal_after_append": "log_appended",
    "wal_after_sync": "log_synced",
    "flush_after_file_sync": "run_written",
    "manifest_after_sst_sync": "run_publish",
    "manifest_after_append": "edit_written",
    "flush_after_publish": "pointer_swapped",
}
FAULTS = {"wal_sync_error": "log_append", "sst_publish_error": "run_publish", "sst_write_error": "run_write"}
EXIT_CODE = 86

CRASH_VARIABLE, FAULT_VARIABLE = "LEDGERLAKE_CRASH_POINT", "LEDGERLAKE_FAULT_POINT"


def is_crash(name: str) -> bool:
    return name == "" or name in CRASHES


def is_fault(name: str) -> bool:
    return name == "" or name in FAULTS


class Faults:
    """A hook with at most one crash and one fault armed. At a place that both name, the crash comes first."""

    def __init__(self, crash: str = "", fault: str = "", end: Callable[[int], None] = os._exit):
        if not is_crash(crash) or not is_fault(fault):
            raise E.InvalidOptionError(f"no such point: {crash or fault}")
        self.crash, self.fault, self._end = crash, fault, end
        self.reset()

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ, end: Callable[[int], None] = os._exit) -> "Faults":
        """What the process was started with; names that are unknown raise."""
        return cls(environment.get(CRASH_VARIABLE, ""), environment.get(FAULT_VARIABLE, ""), end)

    def reset(self) -> None:
        """Arm both again."""
        self._left = {x for x in (self.crash, self.fault) if x}

    def __call__(self, place: str) -> None:
        if self.crash in self._left and CRASHES[self.crash] == place:
            self._left.discard(self.crash)
            self._end(EXIT_CODE)
        if self.fault in self._left and FAULTS[self.fault] == place:
            self._left.discard(self.fault)
            raise E.InjectedFaultError(self.fault)
