"""Line commands over a store: ``command(session, line)`` answers with text.

put get del|delete multiput multiget scan prefix begin commit rollback flush stats ping
set_isolation|setiso get_isolation|getiso help quit|exit
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import ISOLATION
from .store import Store, StoreError, Transaction

ARITY = {"put": 2, "get": 1, "del": 1, "delete": 1, "scan": 2, "prefix": 1, "set_isolation": 1, "setiso": 1}


class Session:
    def __init__(self, store: Store):
        self.store, self.txn, self.over = store, None, False
        self.txn: Transaction | None


def command(s: Session, line: str) -> str:
    """One command; words are split at white space, so values hold none."""
    name, *a = line.split() or [""]
    if name in ARITY and len(a) < ARITY[name]:
        return f"{name} takes {ARITY[name]} arguments"
    at = s.txn or s.store
    show = lambda rows: "\n".join(f"{r.key} = {r.value}" for r in rows)
    try:
        match name:
            case "":
                return ""
            case "put":
                return f"ok {at.put(a[0], a[1]) or ''}".strip()
            case "get":
                v = at.get(a[0])
                return "(not found)" if v is None else v
            case "del" | "delete":
                return f"ok {at.delete(a[0]) or ''}".strip()
            case "multiput":
                if not a or len(a) % 2:
                    return "multiput takes pairs"
                return f"ok {s.store.batch([('put', k, v) for k, v in zip(a[::2], a[1::2], strict=True)])}"
            case "multiget":
                return "\n".join(f"{r.key} = {r.value if r.found else '(not found)'}" for r in s.store.multi_get(a).collect())
            case "scan":
                return show((at.scan(a[0], a[1]) if len(a) < 3 or s.txn else s.store.scan(a[0], a[1], None, int(a[2]))).toLocalIterator())
            case "prefix":
                return show(s.store.prefix(a[0]).toLocalIterator())
            case "begin":
                if s.txn:
                    return "a transaction is open"
                s.txn = s.store.begin(a[0] if a else None)
                return f"begun {s.txn.id} {ISOLATION[s.txn.level]}"
            case "commit" | "rollback":
                if not s.txn:
                    return "no transaction"
                t, s.txn = s.txn, None
                return f"committed {t.commit()}" if name == "commit" else t.rollback() or "rolled back"
            case "flush":
                return f"{s.store.compact()}"
            case "stats":
                return "\n".join(f"{k}: {v}" for k, v in s.store.stats().items())
            case "ping":
                return s.store.ping()["message"]
            case "set_isolation" | "setiso":
                return f"was {ISOLATION[s.store.set_isolation(a[0])]}"
            case "get_isolation" | "getiso":
                return ISOLATION[s.store.isolation]
            case "help":
                return (__doc__ or "").split("\n\n", 1)[1].strip()
            case "quit" | "exit":
                s.over = True
                return "bye"
        return f"unknown command {name}"
    except StoreError as e:
        return f"error: {e}"


def main() -> None:
    p = argparse.ArgumentParser(description="commands over a versioned table")
    p.add_argument("--data", required=True)
    s = Session(Store(SparkSession.builder.getOrCreate(), p.parse_args().data))
    while not s.over:
        try:
            print(command(s, input("> ")))
        except EOFError:
            return


if __name__ == "__main__":
    main()
