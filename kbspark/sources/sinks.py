"""What happens after a commit: webhooks and, where allowed, commands.  Failures are gathered and never undo the commit."""

from __future__ import annotations

import json
import os
import subprocess
import urllib.request
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from kbspark.policy import COMMITTED, EventSink  # noqa: F401

#: Commands of a policy run only where this variable is 1.
ALLOW_COMMANDS = "KB_ALLOW_EXEC_SINKS"
TIMEOUT = 30


@dataclass(frozen=True)
class Event:
    event: str
    kb: str
    manifest: str
    kind: str
    createdBy: str  # noqa: N815 - name of the field sent
    entries: int


def _post(sink: EventSink, body: bytes) -> None:
    request = urllib.request.Request(sink.url, body, {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        if answer.status >= 300:
            raise OSError(f"the webhook answered {answer.status}")


def _command(sink: EventSink, body: bytes, event: Event) -> None:
    if os.environ.get(ALLOW_COMMANDS) != "1":
        raise PermissionError(f"skipped: commands run only with {ALLOW_COMMANDS}=1")
    about = {"KB_EVENT": event.event, "KB_ROOT": event.kb, "KB_MANIFEST": event.manifest, "KB_KIND": event.kind, "KB_CREATED_BY": event.createdBy, "KB_ENTRIES": str(event.entries)}
    done = subprocess.run(["sh", "-c", sink.command], input=body, capture_output=True, timeout=TIMEOUT, env=os.environ | about)
    if done.returncode:
        raise OSError(f"exit {done.returncode}: {(done.stdout + done.stderr).decode(errors='replace').strip()}")


def fire(sinks: Sequence[EventSink], event: Event) -> list[str]:
    """One message for each sink that failed or was skipped; every sink that listens to the event is tried."""
    failed, body = [], json.dumps(asdict(event)).encode()
    for i, sink in enumerate(sinks, 1):
        if sink.on not in ("", event.event):
            continue
        try:
            _post(sink, body) if sink.type == "webhook" else _command(sink, body, event)
        except (OSError, ValueError, subprocess.SubprocessError) as e:
            failed.append(f"sink {i} ({sink.type}): {e}")
    return failed
