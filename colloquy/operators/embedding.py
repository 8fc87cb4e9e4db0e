"""Embedding of messages by an external program, one process for each partition, and the checks before it counts.

The program reads a JSON object a line (id, text) until its input ends, and writes a line that names its model and then an
object a line (id, embedding), in any order, as it likes: at once or when all is read."""

import json
import queue
import subprocess
import threading
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmbedderError
from ..functions.columns import embed_text


@dataclass(frozen=True)
class Model:
    name: str
    dimensions: int


def parse_header(line: str) -> Model:
    try:
        head = json.loads(line)
        if head["type"] == "model":
            return Model(str(head["model"]), int(head["dimensions"]))
    except (ValueError, KeyError, TypeError):
        pass
    raise EmbedderError("the embedder's first line must name its model and dimensions")


class Embedder:
    """A running program. `give` writes messages to it and `taken` returns the answers that have come; `finish` ends its
    input and waits. Every id must come back once, with a vector of the model's width."""

    def __init__(self, provider: str):
        try:
            self.process = subprocess.Popen([provider], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)
        except OSError as e:
            raise EmbedderError(f"the embedder can't be started: {e}") from None
        self.model: Model | None = None
        self.asked: dict[str, str | None] = {}
        self.lines, self.said = queue.SimpleQueue(), []
        # its answers are read all the time, so that neither side waits for the other
        self.readers = [threading.Thread(target=self._read, daemon=True), threading.Thread(target=self._hear, daemon=True)]
        for reader in self.readers:
            reader.start()

    def _read(self) -> None:
        for line in self.process.stdout:
            if line.strip():
                self.lines.put(line)

    def _hear(self) -> None:
        for line in self.process.stderr:
            self.said = [*self.said[-20:], line]

    def give(self, rows: list[tuple[str, str, str | None]]) -> None:
        """rows: id, text, and what to give back with the vector."""
        self.asked.update((key, more) for key, _, more in rows)
        try:
            self.process.stdin.write("".join(json.dumps({"id": key, "text": text}) + "\n" for key, text, _ in rows))
            self.process.stdin.flush()
        except OSError:  # it has ended; finish tells why
            pass

    def taken(self) -> list[tuple[str, str | None, list[float]]]:
        out = []
        while not self.lines.empty():
            line = self.lines.get()
            if self.model is None:
                self.model = parse_header(line)
                continue
            try:
                row = json.loads(line)
                key, vector = row["id"], [float(x) for x in row["embedding"]]
            except (ValueError, KeyError, TypeError):
                raise EmbedderError(f"the embedder's answer can't be read: {line[:200]}") from None
            if key not in self.asked:
                raise EmbedderError(f"the embedder answered an id that wasn't asked for, or twice: {key}")
            if len(vector) != self.model.dimensions:
                raise EmbedderError(f"a vector has {len(vector)} numbers instead of {self.model.dimensions}")
            out.append((key, self.asked.pop(key), vector))
        return out

    def finish(self) -> list[tuple[str, str | None, list[float]]]:
        try:
            self.process.stdin.close()
        except OSError:
            pass
        status = self.process.wait()
        for reader in self.readers:
            reader.join()
        if status:
            raise EmbedderError(f"the embedder ended with status {status}: {''.join(self.said)[-500:]}")
        out = self.taken()
        if self.model is None:
            raise EmbedderError("the embedder gave no answer")
        if self.asked:
            raise EmbedderError(f"the embedder left {len(self.asked)} messages without an answer")
        return out

    def __enter__(self) -> "Embedder":
        return self

    def __exit__(self, *_) -> None:
        if self.process.poll() is None:
            self.process.kill()
            self.process.wait()


def run_embedder(provider: str, inputs: list[tuple[str, str]]) -> tuple[Model, dict[str, list[float]]]:
    """One call: inputs are ids and texts."""
    with Embedder(provider) as program:
        program.give([(key, text, None) for key, text in inputs])
        found = {key: vector for key, _, vector in program.finish()}
        return program.model, found


def candidates(messages: DataFrame, since: Column | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """Messages to embed: those without a vector (or all), taken in since a time, in a fixed order if there is a limit."""
    found = messages if force else messages.where("embedding is null")
    found = found if since is None else found.where(since)
    found = found.select("session_id", "uuid", "source_seq", embed_text(F.col("role"), F.col("content"), F.col("thinking")).alias("text"))
    return found if limit is None else found.orderBy("session_id", "source_seq", "uuid").limit(limit)


def embed(rows: DataFrame, provider: str) -> DataFrame:
    """uuid, session_id, embedding, model, dimensions. A partition starts the program once, if it has rows, and streams them
    through it."""

    def frame(program: Embedder, found: list) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "session_id": [s for _, s, _ in found], "uuid": [k for k, _, _ in found], "embedding": [v for _, _, v in found],
                "model": program.model.name if found else None, "dimensions": program.model.dimensions if found else None
            }
        )

    def run(frames):
        program = None
        for part in frames:
            if len(part):
                program = program or Embedder(provider)
                program.give(list(zip(part["uuid"], part["text"], part["session_id"])))
                if found := program.taken():
                    yield frame(program, found)
        if program:
            with program:
                if found := program.finish():
                    yield frame(program, found)

    return rows.select("session_id", "uuid", "text").mapInPandas(run, "session_id string, uuid string, embedding array<float>, model string, dimensions int")


def one_model(embedded: DataFrame) -> Model | None:
    """The model of all rows; EmbedderError if processes answered with different ones."""
    found = embedded.select("model", "dimensions").distinct().limit(2).collect()
    if len(found) > 1:
        raise EmbedderError(f"the embedder's processes disagree about the model: {found}")
    return Model(found[0].model, found[0].dimensions) if found else None
