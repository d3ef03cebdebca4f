"""Training-data operators: each module is one operator with its own general interface;
``queries`` binds them to the shared tables."""
