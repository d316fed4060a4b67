from __future__ import annotations

import pytest

from chatweave.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "chatweave-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    """lines_of({chat: "text\\nof the file"}) -> chat_lines DataFrame."""

    def build(chats: dict[str, str]):
        rows = [
            (chat, i, line)
            for chat, text in chats.items()
            for i, line in enumerate(text.split("\n"))
        ]
        return spark.createDataFrame(rows, "chat_id string, line_no bigint, line string")

    return build
