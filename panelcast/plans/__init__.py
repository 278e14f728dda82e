"""Composed jobs: standard views, registered queries, walk-forward selection, the frozen pipeline."""
