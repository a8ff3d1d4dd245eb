"""Latent-state, neural and probing models: numpy kernels run as grouped functions, parallel over panels, chains and members."""
