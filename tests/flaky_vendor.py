"""Recorded answers behind a limit: the first calls for each answer are turned away, as many as the file ``limits`` says."""

from pathlib import Path

from marlstone.errors import RateLimited
from marlstone.sources.vendor import RecordedAnswers


class Flaky(RecordedAnswers):
    def fetch(self, symbol, month):
        calls = Path(self.path).parent / "calls"
        calls.mkdir(exist_ok=True)
        n = len(list(calls.glob(f"{symbol}.{month}.*")))
        (calls / f"{symbol}.{month}.{n}").touch()
        if n < int((Path(self.path).parent / "limits").read_text()):
            raise RateLimited("later")
        return super().fetch(symbol, month)
