"""One query per operator, over the whole table, and the SQL that gives the same rows."""

from caselens.llm.queries import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13  # noqa: F401
from caselens.llm.registry import QUERIES, SQL  # noqa: F401
