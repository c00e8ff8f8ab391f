"""Many files are listed and read some at a time, with the results of one read."""

import uuid

import pytest

from tapeloom.contracts import fixed_values as fixed
from tapeloom.operators import quality
from tapeloom.plans import loaders
from tapeloom.session import shared_dir
from tapeloom.sources import raw_files
from tapeloom.sources.store import PANEL, Store


def write(folder, code, columns, days=("2024-01-02", "2024-01-03")):
    values = {**dict.fromkeys(fixed.HISTORY_COLUMNS, "1"), "ticker": code, "name": "x", "close": "11", "pre_close": "10"}
    lines = [",".join(columns)] + [",".join({**values, "trade_date": d}[c] for c in columns) for d in days]
    (folder / f"{code}.csv").write_text("\n".join(lines) + "\n")


def test_history_files_are_read_some_at_a_time(spark, tmp_path, monkeypatch):
    sizes, plain = [], raw_files.read_csv

    def counted(session, paths, columns=None):
        sizes.append(len(paths))
        return plain(session, paths, columns)

    monkeypatch.setattr(raw_files, "read_csv", counted)
    monkeypatch.setattr(raw_files, "FILES_AT_ONCE", 2, raising=False)
    codes = [f"60000{n}" for n in range(7)]
    for n, code in enumerate(codes):  # every third file has a name and another order of columns
        columns = list(fixed.HISTORY_COLUMNS)
        write(tmp_path, code, columns if n % 3 else ["name", *reversed(columns)])
    store = Store(spark, f"some_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), "month")
    store.create_tables()
    report = loaders.load_history_files(store, raw_files.history_files(spark, str(tmp_path)))
    assert max(sizes) == 2
    assert {r.file_name: r.n_rows for r in report.collect()} == {**{f"{c}.csv": 2 for c in codes}, None: 14}
    held = store.snapshot().select("ticker", "name", "close").collect()
    assert len(held) == 14 and {r.ticker: r.name for r in held} == {
        f"{c}.SH": None if n % 3 else "x" for n, c in enumerate(codes)}
    write(tmp_path, "600009", list(fixed.HISTORY_COLUMNS), days=())  # in a chunk of its own
    with pytest.raises(quality.DataCheckError, match="files without rows.*600009"):
        loaders.load_history_files(store, raw_files.history_files(spark, str(tmp_path)))
    assert store.table(PANEL).count() == 14
