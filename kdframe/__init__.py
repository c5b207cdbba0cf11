"""kdframe: the data side of language-model distillation as Spark DataFrame operators.

Column-level expressions live in ``kdframe.functions``, DataFrame operators in
``kdframe.operators``, readers / writers / fixture derivations in
``kdframe.sources``, the registered query catalog and its DuckDB oracles in
``kdframe.plans`` and streaming helpers in ``kdframe.streaming``.
"""

__version__ = "0.1.0"
