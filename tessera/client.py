"""python -m tessera.client HOST PORT: commands from standard input to a server."""

from __future__ import annotations

import socket
import sys

from tessera.sources import wire


class Client:
    def __init__(self, host: str, port: int):
        self.socket = socket.create_connection((host, port))
        self.stream = self.socket.makefile("rwb")

    def exec(self, text: str) -> str:
        wire.send(self.stream, text)
        got = wire.receive(self.stream)
        if got is None:
            raise ConnectionError("the server closed the connection")
        return got

    def close(self) -> None:
        self.stream.close()
        self.socket.close()


def main() -> None:
    c = Client(sys.argv[1], int(sys.argv[2]))
    for line in sys.stdin:
        if text := line.strip():
            got = c.exec(text)
            print(got)
            if got == "BYE":
                break
    c.close()


if __name__ == "__main__":
    main()
