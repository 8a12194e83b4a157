"""Typed failures: a stable code with a message; data-time failures carry the code in raise_error's text."""


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
