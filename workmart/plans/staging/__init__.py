"""Conformers: landed tables of one tool -> rows of a class."""

from workmart.plans.staging import ai, collab, crm, git, people, tasks, wiki  # noqa: F401  (they register models)
