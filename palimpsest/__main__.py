"""python -m palimpsest replicate DB REPLICA [--once] | restore REPLICA OUT [--txid N | --timestamp MS-or-RFC-3339]"""

from __future__ import annotations

import argparse
import time
from datetime import datetime

from .sources.store import Store
from .streaming.database import Database
from .streaming.syncer import Driver, Syncer, restore_to_path, txid_at


def milliseconds(text: str) -> int:
    return int(text) if text.lstrip("-").isdigit() else int(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("replicate")
    r.add_argument("database")
    r.add_argument("replica")
    r.add_argument("--once", action="store_true")
    r.add_argument("--seconds", type=float, default=1.0)
    r = sub.add_parser("restore")
    r.add_argument("replica")
    r.add_argument("out")
    which = r.add_mutually_exclusive_group()
    which.add_argument("--txid", type=int)
    which.add_argument("--timestamp", type=milliseconds)
    a = p.parse_args(argv)
    if a.command == "restore":
        store = Store(a.replica)
        txid = txid_at(store, a.timestamp) if a.timestamp is not None else a.txid
        print(f"restored to transaction {restore_to_path(store, a.out, txid)}")
        return
    syncer = Syncer(Database(a.database), Store(a.replica))
    driver = Driver(syncer)
    try:
        while True:
            report = driver.tick(time.time())
            if a.once:
                print(report)
                break
            time.sleep(a.seconds)
    except KeyboardInterrupt:
        driver.flush()
    finally:
        syncer.close()


if __name__ == "__main__":
    main()
