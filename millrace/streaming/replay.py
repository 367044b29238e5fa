"""A TCP server that replays rows as JSON lines, for trials of socket streams."""

from __future__ import annotations

import socketserver
import threading
import time
from collections.abc import Callable, Iterable


class Replay:
    """Sends each client all lines, one every `pause` seconds; each connection has its own thread."""

    def __init__(self, lines: Callable[[], Iterable[str]], port: int = 0, pause: float = 0.5):
        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                for line in lines():
                    try:
                        self.request.sendall(f"{line}\n".encode())
                    except OSError:
                        return
                    time.sleep(pause)

        self.server = socketserver.ThreadingTCPServer(("127.0.0.1", port), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]

    def __enter__(self) -> Replay:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *exc: object) -> None:
        self.server.shutdown()
        self.server.server_close()
