"""Plans made on the driver: conversion routes that become column expressions."""
