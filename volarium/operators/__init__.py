"""Panel, intraday, graph, regression, evaluation and test operators."""
