"""Incremental republication watch: what each newly observed file is against the last one obtained."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "chave string, observation_id string, artifact_id string, situacao string, versao long"
#: State of the keys is kept in the embedded store that map state and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """One file key: the observations that may still be followed by earlier ones, by time, and the last
    content obtained before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("abertas", "quando long, observation_id string, artifact_id string, obtido boolean, situacao string")
        self.last = handle.getValueState("ultima", "artifact_id string")
        self.version = handle.getValueState("versao", "n long")

    def _known(self) -> dict[tuple, tuple]:
        return {tuple(x)[:2]: tuple(x)[2:] for x in self.open.get()} if self.open.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        known = self._known()
        new: dict[tuple, tuple[str | None, bool]] = {}
        for frame in rows:
            when = frame.observado_em.astype("datetime64[us]").astype("int64")
            for t, name, result, content in zip(when, frame.observation_id, frame.resultado, frame.artifact_id, strict=True):
                named = content if isinstance(content, str) else None
                new[int(t), name] = named, result == "OBTIDO" and named is not None
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        out, held = [], []
        for at in sorted(known.keys() | new.keys()):
            content, got = new[at] if at in new else known[at][:2]
            state = "INCONCLUSIVA" if not got else "NOVA" if before is None else "INALTERADA" if content == before else "CONTEUDO_MUDOU"
            held.append((*at, content, got, state))
            if at in new or known[at][2] != state:
                out.append((key[0], at[1], content, state, version))
            before = content if got else before
        self.open.put(held)  # at once: a call for each observation would cost more than the rest
        self.handle.registerTimer(-(-max(t for t, _ in new) // 1000))  # settles all of this batch and before
        self.version.update((version,))
        yield pd.DataFrame(out, columns=["chave", "observation_id", "artifact_id", "situacao", "versao"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing earlier can come any more: what is settled leaves, but for the last content."""
        until, held = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        for at, (content, got, state) in sorted(self._known().items()):
            if at[0] > until:
                held.append((*at, content, got, state))
            elif got:
                self.last.update((content,))
        self.open.put(held) if held else self.open.clear()
        yield pd.DataFrame([], columns=["chave", "observation_id", "artifact_id", "situacao", "versao"]).astype({"versao": "int64"})

    def close(self) -> None:
        pass


def watch_stream(observations: DataFrame, late: str = "400 days") -> DataFrame:
    """A streaming table of outcomes (chave, observation_id, artifact_id, situacao, versao) from a
    streaming table of observations (chave, observation_id, observado_em, resultado, artifact_id).

    An observation is compared with the last content obtained before it in time, whichever batch it
    came in: one that comes late takes its place, and where it changes what a later one was said to
    be, that one's outcome is given again with a higher ``versao`` (``latest`` keeps the last), so any
    cut of a stream into batches ends in the outcomes of one batch. Observations that are later than
    ``late`` behind the newest are dropped, as the watermark says. A timer settles those that nothing
    earlier can precede, so the state of a key is its recent observations and one content id, which
    does not expire: a key may be republished after years. One id at one time is one observation."""
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = observations.select("chave", "observation_id", "observado_em", "resultado", "artifact_id").withWatermark("observado_em", late)
    return own.groupBy("chave").transformWithStateInPandas(Watch(), OUT, "append", "eventTime")


def latest(outcomes: DataFrame) -> DataFrame:
    """The outcomes as they stand, of a table that the stream wrote."""
    last = F.max_by(F.struct("artifact_id", "situacao"), "versao").alias("u")
    return outcomes.groupBy("chave", "observation_id").agg(last).select("chave", "observation_id", "u.artifact_id", "u.situacao")
