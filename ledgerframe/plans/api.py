"""A thin HTTP front for the serving templates, for one process; routes mirror the template functions."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from . import serve


def answer(networks: dict[str, serve.Network], path: str) -> tuple[int, str, str]:
    """(status, content type, body) of a GET path."""
    parts = [p for p in path.split("?")[0].split("/") if p]
    try:
        if parts[:1] != ["api"] or len(parts) < 2:
            raise LookupError("no such route")
        name, args = parts[1], parts[2:]
        if name == "networks":
            return 200, "application/json", json.dumps([{"name": n.name, "chainid": n.chainid, "systoken": n.systoken, "decimals": n.decimals} for n in networks.values()], sort_keys=True)
        if name == "key":
            return 200, "application/json", serve.to_json(serve.accounts_of_key(networks, *args))
        if name == "codehash":
            return 200, "application/json", serve.to_json(serve.accounts_of_code(networks, *args))
        if name == "status":
            return 200, "text/plain", serve.status_text([r for n in networks.values() for r in _sync(n).collect()])
        net = serve.chain(networks, args[0]) if args else None
        if name == "sync" and net is not None:
            r = _sync(net).first()
            return 200, "text/plain", f"{r.delay} {r.status}\r\n"
        if name == "accinfo" and net is not None:
            key = net["accounts"].sparkSession.createDataFrame([(args[1],)], "account string")
            return 200, "application/json", serve.to_json(serve.account_info(net, key))
        if name in ("rexbalance", "rexraw") and net is not None:
            return 200, "application/json", serve.to_json(serve.rex_of(net, args[1], raw=name == "rexraw"))
        if name in ("action", "block", "health") and net is not None:
            found = {"action": lambda b, q: serve.action(net["actions"], int(b), int(q)), "block": lambda b: serve.block(net["actions"], int(b)), "health": lambda: serve.health(net["blocks"])}[name](*args[1:])
            return 200, "application/json", serve.to_json(found)
        table = {"balances": serve.balances, "account": serve.account, "topholders": lambda n, c, s, k: serve.top_holders(n, c, s, int(k)), "topram": lambda n, k: serve.top_ram(n, int(k)), "topstake": lambda n, k: serve.top_stake(n, int(k))}
        text = {"tokenbalance": serve.token_balance, "holdercount": serve.holder_count, "usercount": serve.user_count}
        if net is not None and name in table:
            return 200, "application/json", serve.to_json(table[name](net, *args[1:]))
        if net is not None and name in text:
            return 200, "text/plain", f"{text[name](net, *args[1:]).first()[0]}\r\n"
        raise LookupError("no such route")
    except LookupError as e:
        return 404, "text/plain", f"{e}\r\n"
    except (ValueError, TypeError, IndexError) as e:
        return 400, "text/plain", f"{e}\r\n"


def _sync(net: serve.Network):
    return serve.sync(net, net["blocks"], F.current_timestamp())


def server(networks: dict[str, serve.Network], host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = answer(networks, self.path)
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
